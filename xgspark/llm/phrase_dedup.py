"""Substring dedup by repeated-phrase automata: recurring passages are
confirmed, compiled into sharded Aho-Corasick automata, and the documents are
streamed through them to locate every occurrence.

Candidate stretches of all documents are dealt by anchor (see ``_repeats``),
so a shard receives every stretch that can hold one of its passages, and no
other.  In a shard, windows of ``WINDOW_WORDS`` words are counted by content
(confirming them); the maximal runs of recurring windows are the passages; the
automaton of the passages then reads every stretch and marks what it finds.
Automata are built over at most about ``AUTOMATON_BYTES`` of passages at a
time, whole anchors together.

Edge cases: a null or wordless text has no words; texts shorter than a window
lose nothing; windows never cross texts and are judged on the input; repeated
rows are copies of each other (all of their windows go); an empty table gives
an empty table; extra columns are never looked at.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xgspark.llm._repeats import WordUnits, merged, repeated, runs_of, unpack, with_runs

WINDOW_WORDS = 35
GRAM_WORDS = 12
AUTOMATON_BYTES = 500_000


def _edges(body: str) -> list[int]:
    """Positions of the blanks around each word of ``" w1 w2 ... "``."""
    out, at = [0], 0
    for w in body[1:-1].split(" "):
        at += len(w) + 1
        out.append(at)
    return out


def recurring_passages(bodies: list[str], counts: list[int], size: int) -> set[str]:
    """Maximal runs of windows that occur twice or more among the stretches
    (each ``" w1 w2 ... "``, standing for ``counts`` occurrences)."""
    seen: Counter[str] = Counter()
    every = []
    for body, n in zip(bodies, counts):
        e = _edges(body)
        windows = [body[e[i]:e[i + size] + 1] for i in range(len(e) - size)]
        every.append((body, e, windows))
        for w in windows:
            seen[w] += n
    out: set[str] = set()
    for body, e, windows in every:
        r = runs_of(np.array([seen[w] > 1 for w in windows], dtype=bool), size)
        out.update(body[e[a]:e[b] + 1] for a, b in zip(r[0::2], r[1::2]))
    return out


def locate(bodies: list[str], passages: set[str]) -> list[list[int]]:
    """Word runs of every passage found in each stretch."""
    import ahocorasick

    if not passages:
        return [[] for _ in bodies]
    automaton = ahocorasick.Automaton()
    for p in passages:
        automaton.add_word(p, p.count(" ") - 1)
    automaton.make_automaton()
    out = []
    for body in bodies:
        found = list(automaton.iter(body))
        if not found:
            out.append([])
            continue
        word = {at: i for i, at in enumerate(_edges(body))}
        out.append([x for end, n in found for x in (word[end] - n, word[end])])
    return out


def resolve(h: np.ndarray, s: np.ndarray, m: np.ndarray, bodies: list[bytes], size: int = WINDOW_WORDS) -> list[list[int]]:
    """Covered word runs of each stretch (rows sorted by anchor ``h``)."""
    texts = [" " + b.decode("utf-8") + " " for b in bodies]
    heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))).tolist()
    passages: set[str] = set()
    for a, b in zip(heads, heads[1:] + [len(texts)]):
        passages |= recurring_passages(texts[a:b], m[a:b].tolist(), size)
    return locate(texts, passages)


def strip_phrases(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW_WORDS,
                  k: int = GRAM_WORDS) -> DataFrame:
    """``doc_id, n_words, spans, kept``: the removed word runs and the
    remaining words, joined by one blank, of every text."""

    def decide(h, s, m, bodies):
        return resolve(h, s, m, bodies, size)

    runs = repeated(docs, WordUnits, size, k, decide, doc_id=doc_id, text=text, resolve_bytes=AUTOMATON_BYTES)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for body, r in zip(unpack(batch["packed"]), batch["runs"]):
                words = body.split()
                sizes.append(len(words))
                if r is None:
                    spans.append([])
                    kept.append(b" ".join(words).decode("utf-8"))
                    continue
                gone = merged(r, len(words))
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8"))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": sizes, "spans": spans, "kept": kept})

    id_type = docs.schema[doc_id].dataType.simpleString()
    return with_runs(docs, runs, doc_id=doc_id, text=text).mapInPandas(
        strip, f"doc_id {id_type}, n_words long, spans array<struct<start:int,end:int>>, kept string")


def op5_phrase_dedup(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    got = strip_phrases(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return got.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of the query's rows: every window counted by its content."""
    n = WINDOW_WORDS
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT row, a, md5(array_to_string(w[a:a + {n - 1}], ' ')) AS h
  FROM docs, unnest(range(1, len(w) - {n - 2})) AS u(a) WHERE len(w) >= {n}),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT row, i FROM windows JOIN repeated USING (h), unnest(range(a, a + {n})) AS u(i)),
words AS (SELECT row, i, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n
  FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM docs LEFT JOIN kept k USING (row)"""
