"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted-target
and the raw-corpus multinomial, length-normalised, and one fixed threshold for
every document.

The n-grams are the runs of three bytes of a text, hashed into ``BUCKETS``
buckets: short enough that a text that was never seen is judged by its
language, case and punctuation, not by the words it happens to share.  Two
multinomials are counted over them: the raw corpus (all documents) and the
trusted target (all documents labelled good quality and not toxic).  A
document's score is the mean over its n-grams of ``log(target / raw)``; it is
kept when the score reaches ``MIN_SCORE`` and the base rules pass.

Every document is scored against the counts *without its own n-grams* (taken
out of the raw counts, and of the target's if it is trusted), so a document
that was labelled is judged like one that was not.  The target is mixed with a
share ``BACKOFF`` of the raw multinomial: an n-gram that no trusted document has
costs ``log(BACKOFF)``, at any size of the corpus.

Scale: two scans of the documents; each task adds its n-grams into one array of
fixed size and sends the buckets it filled, so the sum is a table of at most
``BUCKETS`` rows, which is broadcast.  The trusted ids are marked by a join,
broadcast behind a count; no label is left out.

Edge cases: null and empty texts have no words, fail the base rules and score
0, as do texts under three bytes; labels of absent documents, null or repeated
labels add nothing (an id is trusted when some row says good and none says
toxic); rows that repeat an id are each a document of its own; without any
trusted document every score is 0 and the verdict is that of the base rules;
whole texts of any length count; other columns are never looked at.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xgspark.llm._frame import free_name
from xgspark.llm._text import BYTE_CODE, Rolling, Words, byte_batches, encode, mix64
from xgspark.operators.joins import broadcast_if_small
from xgspark.session import materialize

BUCKETS = 1 << 16
NGRAM_BYTES = 3
BACKOFF = 0.005          # share of the raw multinomial in the target
MIN_SCORE = -1.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BATCH_BYTES = 2_000_000
UNITS = 2 ** 24

# FIXED VALUES: the characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_LINE_BLANK = " \t\r\x0b\x0c"

NGRAM_BASE = 0xC2B2AE3D27D4EB4F
TRIPLE_BASE = 0x9FB21C651E98DF25


def _sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[d]:first[d + 1]]`` for each text."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every run of ``NGRAM_BYTES`` bytes within a text."""
    size = np.diff(words.offset) - 1                   # one blank ends each text
    runs = np.maximum(size - NGRAM_BYTES + 1, 0)
    text = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs) + words.offset[:-1][text]
    run = Rolling(BYTE_CODE[words.data], NGRAM_BASE).slice_hash(at, at + NGRAM_BYTES)
    return (run % np.uint64(BUCKETS)).astype(np.int64), text


def repeated_words(words: Words, codes: np.ndarray, n: int = 3) -> np.ndarray:
    """Words of each text inside an n-word window found twice or more in it."""
    total, count = len(codes), len(words.first) - 1
    text = np.repeat(np.arange(count), np.diff(words.first))
    if total < n:
        return np.zeros(count, dtype=np.int64)
    at = np.arange(total - n + 1)
    at = at[text[at] == text[at + n - 1]]
    window = Rolling(codes, TRIPLE_BASE).slice_hash(at, at + n) ^ mix64(text[at].astype(np.uint64))
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(total, dtype=bool)
    for k in range(n):
        covered[at[twice] + k] = True
    return _sum_by_text(covered.astype(np.int64), words.first)


def duplicate_lines(text: str | None) -> int:
    """Lines (split at ``\\n``) with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(_LINE_BLANK)]
    return len(lines) - len(set(lines))


def _batches(texts: pd.Series):
    raw = [encode(t) for t in texts]
    for a, b in byte_batches(raw, BATCH_BYTES):
        words = Words(raw[a:b])
        yield a, b, words, words.codes()


def count_ngrams(docs: DataFrame, trusted: Column, text: Column) -> DataFrame:
    """``(bucket, raw, target)``: n-gram counts over all documents and over
    the trusted ones; at most ``BUCKETS`` rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((2, BUCKETS), dtype=np.int64)
        for rows in batches:
            good = rows["trusted"].to_numpy(dtype=bool)
            for a, _, words, _ in _batches(rows["text"]):
                bucket, of = ngram_buckets(words)
                both[0] += np.bincount(bucket, minlength=BUCKETS)
                both[1] += np.bincount(bucket[good[a + of]], minlength=BUCKETS)
        filled = np.flatnonzero(both[0])
        yield pd.DataFrame({"bucket": filled, "raw": both[0][filled], "target": both[1][filled]})

    return (docs.select(trusted.alias("trusted"), text.alias("text"))
                .mapInPandas(count, "bucket long, raw long, target long")
                .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and never toxic."""
    return (labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
                  .filter("doc_id is not null and q = 1 and coalesce(t, 0) = 0").select("doc_id"))


def ngram_counts(docs: DataFrame, trusted: Column, text: Column) -> np.ndarray:
    """The two count arrays (raw, target): the model, ``2 * BUCKETS`` numbers."""
    both = np.zeros((2, BUCKETS), dtype=np.int64)
    for r in count_ngrams(docs, trusted, text).collect():           # at most BUCKETS rows
        both[:, r["bucket"]] = r["raw"], r["target"]
    return both


def log_ratios(both: np.ndarray, bucket: np.ndarray, of: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Summed ``log(target / raw)`` of the n-grams of each text, the text's own
    n-grams left out of both; in whole units of ``2 ** -24``, so that a sum is
    the same in any order."""
    summed = np.zeros(len(trusted), dtype=np.int64)
    if not len(bucket) or not both[1].any():
        return summed
    key, times = np.unique(of * BUCKETS + bucket, return_counts=True)
    text, bucket = key // BUCKETS, key % BUCKETS
    own = np.bincount(of, minlength=len(trusted))
    of_target = np.where(trusted[text], times, 0)
    raw = (both[0][bucket] - times + 0.5) / (both[0].sum() - own[text] + 0.5 * BUCKETS)
    left = both[1].sum() - np.where(trusted, own, 0)[text]
    target = (1 - BACKOFF) * (both[1][bucket] - of_target) / np.maximum(left, 1) + BACKOFF * raw
    np.add.at(summed, text, np.round(np.log(target / raw) * UNITS).astype(np.int64) * times)
    summed[(both[1].sum() - np.where(trusted, own, 0)) == 0] = 0      # nothing trusted but the text itself
    return summed


SCORE_TYPE = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, n_ngrams long, log_ratio double")


def measures(text: Column, trusted: Column, both: np.ndarray, spark) -> Column:
    """Struct of the base counts, the n-gram count and the summed log ratio."""
    shared = spark.sparkContext.broadcast(both)

    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        both = shared.value
        for texts, good in batches:
            good, parts = good.to_numpy(dtype=bool), []
            for a, b, words, codes in _batches(texts):
                bucket, of = ngram_buckets(words)
                letters = words.inside & ((words.data & 0xC0) != 0x80)
                parts.append(pd.DataFrame({
                    "n_words": np.diff(words.first),
                    "word_chars": _sum_by_text(letters.astype(np.int64), words.offset),
                    "n_symbols": _sum_by_text(_IS_SYMBOL[words.data], words.offset),
                    "n_dup_lines": [duplicate_lines(t) for t in texts.iloc[a:b]],
                    "n_repeat_words": repeated_words(words, codes),
                    "n_ngrams": np.bincount(of, minlength=b - a),
                    "log_ratio": log_ratios(both, bucket, of, good[a:b]) / UNITS}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
                {c.split()[0]: [] for c in SCORE_TYPE.split(", ")})

    return F.pandas_udf(measure, SCORE_TYPE)(text, trusted)


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          min_score: float = MIN_SCORE) -> DataFrame:
    """All columns of the documents plus one struct column ``quality`` (a
    longer name if taken): base counts, ``base_failed``, ``score``, ``kept``."""
    m_name, good = free_name(docs, "measures"), free_name(docs, "good_id")
    ids = materialize(trusted_ids(labels).withColumnRenamed("doc_id", good), "trusted-ids")
    marked = docs.join(broadcast_if_small(ids), docs[doc_id] == ids[good], "left")
    trusted = F.col(good).isNotNull()
    both = ngram_counts(marked.select(trusted.alias("trusted"), F.col(text).alias("body")), F.col("trusted"), F.col("body"))
    out = marked.withColumn(m_name, measures(F.col(text), trusted, both, docs.sparkSession)).drop(good)
    m = F.col(m_name)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    mean = F.when(m["n_ngrams"] > 0, m["log_ratio"] / m["n_ngrams"]).otherwise(0.0)
    fields = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.withColumn(free_name(docs, "quality"), F.struct(
        *fields, failed.alias("base_failed"), mean.alias("score"),
        (~failed & (mean >= F.lit(min_score))).alias("kept"))).drop(m_name)


def op10_quality(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "quality.*")
