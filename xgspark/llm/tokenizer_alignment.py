"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers split the same bytes (a space and the text).  Where both have a
token end, the text can be cut.  An interval of tokens is cut at a common end
near its middle: the middle end of one side is looked up among the other side's
ends by bisect, then the ends around it in widening rings.  Both halves are cut
in turn; an interval without a common end inside is a leaf, a *group* of tokens.
All intervals of a level, of all texts of a batch, are cut at once in numpy, so
a batch takes about ``log2(tokens)`` rounds; the rings double, so a long
interval without any cut costs its length once a level.

Every pair of tokens of a group whose bytes overlap is a *link*.  How often an
id pair is linked is counted over all documents; a link is *best* when no other
partner of its B id is linked more often (ties are all best).

Scale: texts are tokenized once, in the scan (a word that comes again in the
task is looked up: where a letter is followed by one space and another letter,
no token of either vocabulary reaches across, which is checked).  What is kept of a document is
its distinct id pairs with their counts (one written table); the pair counts
are one map-side combined aggregate.  Back at the documents, the pairs of the
``FREQUENT_PAIRS`` most frequent at most (those of at least a power of two of
links) are looked up in a broadcast of bounded size, the rest, rare by
definition, by a join.  Both ways give the same counts.

Edge cases: null and empty texts, and texts whose joined token bytes differ
from the space and the text in either vocabulary, have no tokens: zeros and an
empty group string; special tokens' strings are plain text; repeated rows each
count; whole texts of any length are tokenized; other columns stay.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xgspark.llm._frame import free_name, once_a_worker
from xgspark.llm._text import byte_batches
from xgspark.session import materialize

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 500_000
FREQUENT_PAIRS = 500_000
LOOK_UP_ROWS = 1_000
KNOWN_PARTS = 400_000            # parts between words whose tokens a task remembers
SPACE = "▁"                 # FIXED VALUE: how B writes a space
# FIXED VALUE: how byte-level vocabularies split a text before merging.
BYTE_LEVEL_PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LETTER = "[!-~\u00C0-\u024F]"    # printable ASCII and Latin letters: no white space in any reading


def byte_letters() -> dict[str, int]:
    """The letter a byte-level vocabulary writes for each byte: printable
    Latin-1 stands for itself, the others for the letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Vocabularies:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode("utf-8"))
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a: dict[int, bytes] = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in letters for c in token)
            self.bytes_a[i] = bytes(letters[c] for c in token) if known else token.encode("utf-8")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(SPACE, " ").encode("utf-8")
                        for i in range(self.b.get_piece_size())]
        self.size_a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        for i, raw in self.bytes_a.items():
            self.size_a[i] = len(raw)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        digits = [[str(i) + mark for i in range(max(len(self.size_a), len(self.size_b)))] for mark in ",|;"]
        self.inner, self.last_a, self.last_b = (np.array(d, dtype=object) for d in digits)
        self.word = re.compile(f" {LETTER}+")
        self.ranked = None
        self.border = re.compile(f"(?<={LETTER})(?= {LETTER})") if self._words_stand_alone(a) else None
        if self.border:
            self.ranked = self._by_rank(a)
        self._forget()

    def _words_stand_alone(self, a: bytes) -> bool:
        """Whether neither vocabulary has a token that reaches over the border
        between a printable letter and a single space before another one: A
        splits there first (byte-level pattern), B has no piece with a space
        behind another letter."""
        before = json.loads(a).get("pre_tokenizer") or {}
        return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any(
            SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b.get_piece_size()))

    def _encode_a(self, parts: list[str]) -> list[list[int]]:
        """Ids of A: single words by the merge ranks, everything else by the
        tokenizer itself."""
        if not self.ranked:
            return [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        word = [self.word.fullmatch(p) is not None for p in parts]
        others = iter(self.a.encode_batch_fast([p for p, w in zip(parts, word) if not w], add_special_tokens=False))
        by_rank = self.ranked.encode_ordinary
        return [by_rank(p) if w else next(others).ids for p, w in zip(parts, word)]

    def _by_rank(self, a: bytes):
        """A tiktoken encoder of the same vocabulary, when its ids stand in the
        order of its merges; else None."""
        import tiktoken

        model = json.loads(a)["model"]
        vocabulary = model.get("vocab") or {}
        made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges") or []]
        if None in made or made != sorted(made) or model.get("type") != "BPE" or min(made, default=0) < 256:
            return None
        merged = set(made)
        ranks = {raw: i for i, raw in self.bytes_a.items() if i in merged or len(raw) == 1}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_parts(self, parts: list[str]) -> None:
        """Adds parts (each begins with a space) to the table of known ones."""
        sides = (self._encode_a(parts), self.b.encode([p[1:] for p in parts], num_threads=1))
        raw = [p.encode("utf-8") for p in parts]
        exact = np.ones(len(parts), dtype=bool)
        for ids, names, size, flat, ends in ((sides[0], self.bytes_a, self.size_a, self.flat_a, self.ends_a),
                                             (sides[1], self.bytes_b, self.size_b, self.flat_b, self.ends_b)):
            one = array("q", chain.from_iterable(ids))
            if b"".join(map(names.__getitem__, one)) != b"".join(raw):
                exact &= np.array([b"".join(map(names.__getitem__, x)) == r for x, r in zip(ids, raw)])
            else:                                        # equal as a whole: equal where the parts' sizes agree
                end = np.cumsum([len(x) for x in ids])
                total = np.concatenate(([0], np.cumsum(size[np.frombuffer(one, dtype=np.int64)])))
                exact &= total[end] == np.cumsum([len(r) for r in raw])
            ends.extend((np.cumsum([len(x) for x in ids]) + len(flat)).tolist())
            flat.extend(one)
        self.known.update(zip(parts, range(len(self.exact), len(self.exact) + len(parts))))
        self.exact.extend(exact.tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(ids of A, how many each text has, ids of B, how many)``, the texts
        one after the other; an empty text, and one that either vocabulary does
        not give back byte by byte, has none.  A part between two words is
        tokenized once and looked up after that."""
        parts_of = [self.border.split(" " + t) if self.border else [" " + t] if t else [] for t in texts]
        if len(self.known) > KNOWN_PARTS or len(self.flat_a) > 16 * KNOWN_PARTS:
            self._forget()
        parts = list(chain.from_iterable(parts_of))
        missing = set(parts).difference(self.known)
        if missing:
            self._encode_parts(sorted(missing))
        part = np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))
        text = np.repeat(np.arange(len(texts)), [len(p) for p in parts_of])
        bad = np.array([not t for t in texts], dtype=bool)
        # Views of the tables, not copies: they are let go before the tables grow again.
        for i in np.unique(text[~np.frombuffer(self.exact, dtype=bool)[part]]) if len(part) else ():
            bad[i] = not self._gives_back(" " + texts[i], part[text == i])
        part, text = part[~bad[text]], text[~bad[text]]
        out = []
        for flat, ends in ((self.flat_a, self.ends_a), (self.flat_b, self.ends_b)):
            ends = np.frombuffer(ends, dtype=np.int64)
            at, of = _ragged(ends[part], ends[part + 1])
            out += [np.frombuffer(flat, dtype=np.int64)[at] if len(at) else np.zeros(0, dtype=np.int64), np.bincount(text[of], minlength=len(texts))]
        return tuple(out)

    def _gives_back(self, text: str, parts: np.ndarray) -> bool:
        joined = [b"".join(names[i] for p in parts for i in flat[ends[p]:ends[p + 1]])
                  for names, flat, ends in ((self.bytes_a, self.flat_a, self.ends_a), (self.bytes_b, self.flat_b, self.ends_b))]
        return joined[0] == joined[1] == text.encode("utf-8")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.exact = bytearray()
        self.flat_a, self.flat_b, self.ends_a, self.ends_b = array("q"), array("q"), array("q", [0]), array("q", [0])


def _ragged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``[first, end)`` and the range of each."""
    size = np.maximum(end - first, 0)
    of = np.repeat(np.arange(len(first)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def cut_near_middle(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each interval ``[lo, hi)`` of A's ends, the index of the common end
    nearest its middle; -1 when it has none."""
    mid = (lo + hi) // 2
    cut = np.full(len(lo), -1, dtype=np.int64)

    def common(i: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ends_b, ends_a[i])
        return ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a[i]

    hit = common(mid)
    cut[hit] = mid[hit]
    near, far = 1, 2                                   # the ring: distances near .. far - 1
    left = np.flatnonzero(~hit & (hi - lo > 1))
    while len(left):
        m, a, b = mid[left], lo[left], hi[left]
        below, of_below = _ragged(np.maximum(a, m - far + 1), m - near + 1)
        above, of_above = _ragged(m + near, np.minimum(b, m + far))
        i, of = np.concatenate((below, above)), np.concatenate((of_below, of_above))
        ok = common(i)
        i, of = i[ok], of[ok]
        best = np.full(len(left), np.iinfo(np.int64).max)
        np.minimum.at(best, of, np.abs(i - m[of]) * 2 + (i > m[of]))
        got = best < np.iinfo(np.int64).max
        away = best // 2
        cut[left[got]] = np.where(best % 2 == 1, m + away, m - away)[got]
        near, far = far, far * 2
        left = left[~got & ((m - near >= a) | (m + near < b))]
    return cut


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Indices of A's tokens that end where a token of B ends, by divide and
    conquer.  Ends ascend strictly and their last ones are equal."""
    n = len(ends_a)
    found = np.zeros(n, dtype=bool)
    if not n:
        return np.zeros(0, dtype=np.int64)
    found[n - 1] = True
    lo, hi = np.array([0]), np.array([n - 1])
    while True:
        open_ = hi > lo
        lo, hi = lo[open_], hi[open_]
        if not len(lo):
            return np.flatnonzero(found)
        cut = cut_near_middle(ends_a, ends_b, lo, hi)
        has = cut >= 0
        lo, hi, cut = lo[has], hi[has], cut[has]
        found[cut] = True
        lo, hi = np.concatenate((lo, cut + 1)), np.concatenate((cut, hi))


def align(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, v: Vocabularies) -> dict:
    """Groups and links of several texts: the ids of both sides, text after
    text, and how many each text has (same bytes on both sides)."""
    ends_a, ends_b = np.cumsum(v.size_a[a]), np.cumsum(v.size_b[b])
    last_a = shared_cuts(ends_a, ends_b)                      # last A token of every group
    last_b = np.searchsorted(ends_b, ends_a[last_a])
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    # The group string: A's ids, a bar, B's ids, a semicolon, group after group.
    group_a, group_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
    pieces = np.empty(len(a) + len(b), dtype=object)
    closes_a, closes_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    closes_a[last_a], closes_b[last_b] = True, True
    pieces[np.arange(len(a)) + (last_b - in_b + 1)[group_a]] = np.where(closes_a, v.last_a[a], v.inner[a])
    pieces[np.arange(len(b)) + (last_a + 1)[group_b]] = np.where(closes_b, v.last_b[b], v.inner[b])
    # Links: a group of one and one is one link; in the others, two tokens overlap
    # where one's bytes reach past the other's last end.
    single = (in_a == 1) & (in_b == 1)
    many_a, many_b = np.flatnonzero(~single[group_a]), np.flatnonzero(~single[group_b])
    edges = np.union1d(ends_a[many_a], ends_b[many_b])
    link_a = np.concatenate((last_a[single], many_a[np.searchsorted(ends_a[many_a], edges)]))
    link_b = np.concatenate((last_b[single], many_b[np.searchsorted(ends_b[many_b], edges)]))
    end_of = np.cumsum(n_a)
    text = np.searchsorted(end_of, link_a, side="right")
    span = len(v.size_a) * len(v.size_b)
    key, times = np.unique(text * span + a[link_a] * len(v.size_b) + b[link_b], return_counts=True)
    of, pair = key // span, key % span
    codes = ((pair // len(v.size_b)) << 32) | (pair % len(v.size_b))
    cut = np.searchsorted(of, np.arange(len(n_a) + 1))
    text_at, groups = np.concatenate(([0], np.cumsum(n_a + n_b))), np.searchsorted(end_of, last_a, side="right")
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(groups, minlength=len(n_a)),
            "groups": ["".join(pieces[s:e].tolist())[:-1] for s, e in zip(text_at[:-1], text_at[1:])],
            "pairs": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(codes)),
            "links": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(times.astype(np.int64)))}


ALIGN_TYPE = "n_a long, n_b long, n_groups long, groups string, pairs array<long>, links array<long>"


def aligned(docs: DataFrame, text: str, carry: Sequence[str], name: str, vocabulary_a: str = VOCABULARY_A,
            vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """The columns ``carry`` and a struct ``name``: token and group counts, the
    groups as ``a1,a2|b1;a3|b2,b3``, the distinct id pairs (``a << 32 | b``) and
    how many links each has.  Rows go out in pieces of about ``BATCH_BYTES``."""
    with open(vocabulary_a, "rb") as fa, open(vocabulary_b, "rb") as fb:
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, fa.read(), fb.read()))   # two files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, *files = shared.value
        v = once_a_worker("vocabularies", key, lambda: Vocabularies(*files))
        for rows in batches:
            texts = [t or "" for t in rows.column("text").to_pylist()]
            for s, e in byte_batches(texts, BATCH_BYTES):
                found = {k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in align(*v.encode(texts[s:e]), v).items()}
                yield pa.RecordBatch.from_arrays(
                    [rows.column("kept").slice(s, e - s), pa.StructArray.from_arrays(list(found.values()), list(found))],
                    ["kept", "found"])

    # A constant field keeps the struct from being empty when nothing is carried.
    kept = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("kept"),
                       F.col(text).alias("text"))
    fields = kept.schema["kept"].dataType.simpleString()
    out = kept.mapInArrow(run, f"kept {fields}, found struct<{ALIGN_TYPE.replace(' ', ':').replace(',:', ',')}>")
    return out.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carry)], F.col("found").alias(name))


def pair_counts(table: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links of each id pair over all rows of ``table``
    (``pairs``, ``links``), and whether no partner of its B id has more."""
    pairs = (table.select(F.explode(F.arrays_zip("pairs", "links")).alias("x"))
                  .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("n")))
    pairs = materialize(pairs.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))                # one row a B id
    return pairs.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def least_frequent_count(pairs: DataFrame, limit: int) -> int:
    """The smallest power of two that at most ``limit`` pairs reach."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()      # at most 63 rows
    total, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["power"]):
        total += r["count"]
        if total > limit:
            break
        least = 1 << r["power"]
    return least


def align_documents(docs: DataFrame, *, text: str = "text", vocabulary_a: str = VOCABULARY_A,
                    vocabulary_b: str = VOCABULARY_B, frequent: int = FREQUENT_PAIRS,
                    carry: Sequence[str] | None = None, keep_groups: bool = True) -> DataFrame:
    """The columns ``carry`` of the documents (default: all) plus one struct
    column ``alignment`` (a longer name if taken): ``n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256`` and, with ``keep_groups``,
    ``groups``."""
    spark = docs.sparkSession
    carry = list(docs.columns if carry is None else carry)
    name, key, x_name, k_name, b_name, s_name = (
        free_name(docs, n) for n in ("alignment", "row", "aligned", "row_again", "more_best", "more_sum"))
    x = F.col(x_name)
    digest = F.when(x["groups"] != "", F.sha2(x["groups"], 256)).otherwise(F.lit(""))
    fields = [x[c].alias(c) for c in ("n_a", "n_b", "n_groups", *(["groups"] if keep_groups else []))]
    table = materialize(aligned(docs, text, carry, x_name, vocabulary_a, vocabulary_b).select(
        *carry, F.monotonically_increasing_id().alias(key),
        F.struct(*fields, (x["n_a"] + x["n_b"] - x["n_groups"]).alias("n_links"), digest.alias("groups_sha256"))
        .alias(name), F.struct(x["pairs"].alias("pairs"), x["links"].alias("links")).alias(x_name)), "aligned")
    pairs = materialize(pair_counts(table.select(f"{x_name}.*")), "pairs")
    least = least_frequent_count(pairs, frequent)
    known = pairs.filter(F.col("n") >= least).toArrow()                            # at most `frequent` rows
    order = np.argsort(known["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(
        tuple(known[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, LOOK_UP_ROWS):
                rows = whole.slice(start, LOOK_UP_ROWS)
                pairs = rows.column("pairs")
                of = np.asarray(pc.list_parent_indices(pairs), dtype=np.int64)
                pair, links = np.asarray(pairs.flatten()), np.asarray(rows.column("links").flatten())
                at = np.minimum(np.searchsorted(codes, pair), max(len(codes) - 1, 0))
                hit = codes[at] == pair if len(codes) else np.zeros(len(pair), dtype=bool)
                sums = np.zeros((2, len(rows)), dtype=np.int64)
                np.add.at(sums[0], of[hit], links[hit] * best[at[hit]])
                np.add.at(sums[1], of[hit], links[hit] * n[at[hit]])
                cut = pa.array(np.searchsorted(of[~hit], np.arange(len(rows) + 1)), pa.int32())
                found = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]),
                         "rare": pa.ListArray.from_arrays(cut, pa.array(pair[~hit])),
                         "rare_links": pa.ListArray.from_arrays(cut, pa.array(links[~hit]))}
                yield pa.RecordBatch.from_arrays(
                    [rows.column("kept"), pa.StructArray.from_arrays(list(found.values()), list(found))], ["kept", "found"])

    kept = table.select(F.struct(F.col(key).alias("k"), F.col(name).alias("a"),
                                 *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("kept"), f"{x_name}.*")
    found = kept.mapInArrow(look_up, f"kept {kept.schema['kept'].dataType.simpleString()}, found struct<n_best:long,"
                                     "count_sum:long,rare:array<long>,rare_links:array<long>>") \
                .select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carry)], F.col("kept.k").alias(key),
                        F.col("kept.a").alias(name), F.col("found").alias(x_name))
    rest = (found.select(F.col(key).alias(k_name), x["rare"].alias("rare"), x["rare_links"].alias("rare_links"))
                 .select(k_name, F.explode(F.arrays_zip("rare", "rare_links")).alias("r"))
                 .select(k_name, F.col("r.rare").alias("pair"), F.col("r.rare_links").alias("l"))
                 .join(pairs.filter(F.col("n") < least), "pair")
                 .groupBy(k_name).agg(F.sum(F.when(F.col("best"), F.col("l")).otherwise(0)).alias(b_name),
                                      F.sum(F.col("l") * F.col("n")).alias(s_name)))
    both = found.join(rest, F.col(key) == F.col(k_name), "left")
    total = [(x[c] + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", b_name), ("count_sum", s_name))]
    return both.select(*carry, F.struct(f"{name}.*", *total).alias(name))


def op12_alignment(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    a = F.col("alignment")
    # The text is not needed after tokenizing: the written table leaves it out.
    return align_documents(docs, carry=["doc_id"], keep_groups=False).select("doc_id", *[
        a[c].alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])
