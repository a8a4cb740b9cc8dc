"""Repeated windows: the part that suffix-array and automaton dedup share.

A window is ``size`` consecutive units (bytes or words) of one text.  Finding
those that start in two places takes four steps, none of which brings a whole
text, a hot passage or all windows into one task:

1. *Anchors.*  Every window points at its smallest ``k``-gram hash (leftmost on
   ties).  Equal windows point at equal k-grams, so a window whose anchor is
   unique is unique.  Neighbouring windows share an anchor: one *segment* row
   ``(h, s, row_key, lo, n)`` stands for the ``n`` windows that start at ``lo``
   on; ``h`` hashes the anchor, ``s`` the units of the whole segment.
2. *Counts* of ``h`` (a map-side aggregate) leave the segments whose anchor
   occurs twice; equal segments are collapsed to one with its multiplicity.
3. *Resolve.*  Texts of the distinct segments are brought together by ``h`` and
   the operator decides on the content (suffix array, automaton).  An anchor
   with more than ``GROUP_SEGMENTS`` distinct segments (a passage that very
   many texts share, at its borders) is not gathered: its windows are counted
   one by one under ``(h, hash of the window)``, 128 bits, in an aggregate.
4. The repeated runs go back to all occurrences by ``(h, s)``, and to the texts.

Joins are plain shuffle joins, which Spark splits when one side is skewed.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xgspark.llm._frame import row_key
from xgspark.llm._text import BYTE_CODE, Rolling, Words, byte_batches, encode, mix64
from xgspark.operators.joins import broadcast_if_small
from xgspark.session import materialize, materialize_counted, scratch_path

GRAM_BASE = 0x9E6C63D0676A9A99
SEGMENT_BASE = 0xD8163841FDE6A8F9
WINDOW_BASE = 0xA0761D6478BD642F
GROUP_SEGMENTS = 32
BATCH_BYTES = 1_000_000
PIECE_UNITS = 1_000_000     # longer texts are cut, pieces overlapping by a window less one
_POSITION = np.uint64((1 << 24) - 1)

SEGMENT_TYPE = "row_key long, lo int, n int, h long, s long"


def segments(codes: np.ndarray, first: np.ndarray, size: int, k: int):
    """Segments of texts laid end to end (text ``d`` has the units
    ``first[d]:first[d + 1]``): arrays ``text, lo, n, h, s``."""
    total = len(codes)
    none = np.zeros(0, dtype=np.int64)
    if total < size:
        return none, none, none, none, none
    assert total <= int(_POSITION)
    rolling = Rolling(codes, GRAM_BASE)
    at = np.arange(total - k + 1)
    gram = rolling.slice_hash(at, at + k)
    least = (gram & ~_POSITION) | at.astype(np.uint64)
    reach, span = size - k + 1, 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    windows = total - size + 1
    least = np.minimum(least[:windows], least[reach - span:reach - span + windows])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(text[:windows] == text[size - 1:])
    if not len(start):
        return none, none, none, none, none
    anchor = (least[start] & _POSITION).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    lo, hi = start[head], start[np.append(head[1:], len(start)) - 1]
    anchor = anchor[head]
    whole = Rolling(codes, SEGMENT_BASE).slice_hash(lo, hi + size)
    s = mix64(whole ^ (anchor - lo).astype(np.uint64))
    d = text[lo]
    return d, lo - first[d], hi - lo + 1, gram[anchor], s


class Bytes:
    """Units are the bytes of the UTF-8 text."""

    @staticmethod
    def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        return BYTE_CODE[data], first

    @staticmethod
    def slices(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        return [text[a:b] for a, b in zip(lo.tolist(), hi.tolist())]

    @staticmethod
    def pieces(text: bytes, size: int) -> list[tuple[int, bytes]]:
        """``(first unit, text)`` of a text, cut when it is very long."""
        if len(text) <= PIECE_UNITS:
            return [(0, text)]
        return [(a, text[a:a + PIECE_UNITS + size - 1]) for a in range(0, len(text) - size + 1, PIECE_UNITS)]


class WordUnits:
    """Units are words."""

    @staticmethod
    def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        return words.codes(), words.first

    @staticmethod
    def slices(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]

    @staticmethod
    def pieces(text: bytes, size: int) -> list[tuple[int, bytes]]:
        if len(text) <= 4 * PIECE_UNITS:
            return [(0, text)]
        words = text.split()
        step = PIECE_UNITS // 4
        return [(a, b" ".join(words[a:a + step + size - 1])) for a in range(0, max(1, len(words) - size + 1), step)]


def _segment_rows(unit, size: int, k: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, firsts, texts = [], [], []
            for key, text in zip(batch["row_key"].tolist(), batch["text"]):
                for a, piece in unit.pieces(encode(text), size):
                    keys.append(key)
                    firsts.append(a)
                    texts.append(piece)
            keys, firsts = np.array(keys, dtype=np.int64), np.array(firsts, dtype=np.int64)
            for a, b in byte_batches(texts, BATCH_BYTES):
                d, lo, n, h, s = segments(*unit.codes(texts[a:b]), size, k)
                yield pd.DataFrame({"row_key": keys[a:b][d], "lo": (firsts[a:b][d] + lo).astype(np.int32),
                                    "n": n.astype(np.int32), "h": h.astype(np.uint64).view(np.int64),
                                    "s": s.astype(np.uint64).view(np.int64)})
    return rows


def packed(text: Column) -> Column:
    """The text's UTF-8, compressed for a shuffle."""

    @F.pandas_udf("binary")
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for t in texts:
            yield pd.Series([c.compress(encode(x)) for x in t], dtype=object)

    return pack(text)


def unpack(values) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(v) for v in values]


CONTENT_TYPE = "h long, s long, m long, body binary, window long, off int"


def _content_rows(unit, size: int):
    """Texts of the distinct segments; of those with a crowded anchor, the
    hashes of their windows instead."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {c: [] for c in ("h", "s", "m", "body", "window", "off")}
            for text, h, s, m, lo, n, crowded in zip(unpack(batch["packed"]), *(batch[c] for c in
                                                     ("h", "s", "m", "lo", "n", "crowded"))):
                h, s, m, lo, n = (np.asarray(x, dtype=np.int64) for x in (h, s, m, lo, n))
                crowded = np.asarray(crowded, dtype=bool)
                few = np.flatnonzero(~crowded)
                if len(few):
                    out["body"] += unit.slices(text, lo[few], lo[few] + n[few] + size - 1)
                    for c, v in (("h", h[few]), ("s", s[few]), ("m", m[few])):
                        out[c].append(v)
                    out["window"].append(np.zeros(len(few), dtype=np.int64))
                    out["off"].append(np.full(len(few), -1))
                many = np.flatnonzero(crowded)
                if len(many):
                    codes, _ = unit.codes([text])
                    which = np.repeat(many, n[many])
                    off = np.arange(len(which)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                    at = lo[which] + off
                    out["body"] += [None] * len(which)
                    for c, v in (("h", h[which]), ("s", s[which]), ("m", m[which])):
                        out[c].append(v)
                    out["window"].append(Rolling(codes, WINDOW_BASE).slice_hash(at, at + size).view(np.int64))
                    out["off"].append(off)
                if len(out["body"]) > 100_000:
                    yield _frame(out)
                    out = {c: [] for c in out}
            yield _frame(out)

    def _frame(out):
        flat = {c: np.concatenate(out[c]) if out[c] else np.zeros(0, dtype=np.int64)
                for c in ("h", "s", "m", "window", "off")}
        flat["off"] = flat["off"].astype(np.int32)
        return pd.DataFrame({"h": flat["h"], "s": flat["s"], "m": flat["m"],
                             "body": pd.Series(out["body"], dtype=object),
                             "window": flat["window"], "off": flat["off"]})

    return rows


RUNS_TYPE = "h long, s long, runs array<int>"


def runs_of(flags: np.ndarray, size: int) -> list[int]:
    """Covered units of a segment from the flags of its windows, as
    ``[start, end, start, end, ...]``."""
    on = np.flatnonzero(flags)
    if not len(on):
        return []
    cut = np.flatnonzero(np.diff(on) > size)
    starts = on[np.concatenate(([0], cut + 1))]
    ends = on[np.concatenate((cut, [len(on) - 1]))] + size
    return np.stack((starts, ends), axis=1).ravel().tolist()


def by_group(batches: Iterator[pd.DataFrame], resolve: Callable, most_bytes: int) -> Iterator[pd.DataFrame]:
    """Feed ``resolve(h, s, m, bodies)`` with whole groups of ``h`` (rows
    arrive sorted by it), about ``most_bytes`` of text at a time."""
    held: list[pd.DataFrame] = []
    size = 0

    def flush(frame):
        runs = resolve(frame["h"].to_numpy(), frame["s"].to_numpy(), frame["m"].to_numpy(), frame["body"].tolist())
        some = [i for i, r in enumerate(runs) if r]
        return pd.DataFrame({"h": frame["h"].to_numpy()[some], "s": frame["s"].to_numpy()[some],
                             "runs": pd.Series([runs[i] for i in some], dtype=object)})

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += int(batch["body"].str.len().sum())
        if size < most_bytes:
            continue
        frame = pd.concat(held, ignore_index=True)
        h = frame["h"].to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        ends = np.cumsum(frame["body"].str.len().to_numpy())
        begin = 0
        for stop in heads[1:]:                       # the last group may go on
            if ends[stop - 1] - (ends[begin - 1] if begin else 0) >= most_bytes or stop == heads[-1]:
                yield flush(frame.iloc[begin:stop])
                begin = stop
        held = [frame.iloc[begin:]]
        size = int(held[0]["body"].str.len().sum())
    if held:
        yield flush(pd.concat(held, ignore_index=True))


def repeated(docs: DataFrame, unit, size: int, k: int, resolve: Callable, *, doc_id: str, text: str,
             resolve_bytes: int) -> DataFrame:
    """``row_key, runs``: for each text with a repeated window, the covered
    units as ``[start, end, start, end, ...]`` (runs may overlap, any order)."""
    spark = docs.sparkSession
    body = docs.select(row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    every = body.mapInPandas(_segment_rows(unit, size, k), SEGMENT_TYPE)
    twice = materialize(every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "anchors")
    found = materialize(every.join(twice, "h").select("row_key", "lo", "n", "h", "s"), "segments")

    distinct = materialize(found.groupBy("h", "s").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("row_key", "lo", "n")).alias("at")), "distinct-segments")
    crowded, n_crowded = materialize_counted(
        distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > GROUP_SEGMENTS)
                .select(F.col("h").alias("crowded_h")), "crowded")
    # Broadcast when it is counted as small: no shuffle gathers a crowded anchor.
    crowded = broadcast_if_small(crowded, known_rows=n_crowded)
    entry = F.struct("h", "s", "m", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"),
                     F.col("crowded_h").isNotNull().alias("crowded"))
    wanted = distinct.join(crowded, F.col("h") == F.col("crowded_h"), "left") \
                     .groupBy(F.col("at.row_key").alias("row_key")).agg(F.collect_list(entry).alias("e")) \
                     .select("row_key", "e.h", "e.s", "e.m", "e.lo", "e.n", "e.crowded")
    path = scratch_path(spark, "contents")
    (body.select("row_key", packed(F.col("text")).alias("packed")).dropDuplicates(["row_key"])
         .join(wanted, "row_key").drop("row_key")
         .mapInPandas(_content_rows(unit, size), CONTENT_TYPE)
         .write.option("compression", "zstd").parquet(path))
    content = spark.read.schema(CONTENT_TYPE).parquet(path)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from by_group(batches, resolve, resolve_bytes)

    gathered = content.filter("off < 0").select("h", "s", "m", "body").repartition("h") \
                      .sortWithinPartitions("h").mapInPandas(decide, RUNS_TYPE)
    windows = content.filter("off >= 0").select("h", "s", "m", "window", "off")
    often = windows.groupBy("h", "window").agg(F.sum("m").alias("c")).filter("c > 1").select("h", "window")
    # Every window of a segment that occurs twice is repeated; the others are looked up.
    counted = windows.filter("m > 1").unionByName(windows.filter("m = 1").join(often, ["h", "window"]).select(*windows.columns)) \
                     .groupBy("h", "s").agg(F.flatten(F.collect_list(F.array("off", F.col("off") + size))).alias("runs"))
    runs = gathered.unionByName(counted)
    return (found.join(runs, ["h", "s"])
                 .select("row_key", F.transform("runs", lambda x: x + F.col("lo")).alias("runs"))
                 .groupBy("row_key").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def merged(runs, total: int) -> np.ndarray:
    """Mask of the covered units."""
    step = np.zeros(total + 1, dtype=np.int32)
    if runs is not None and len(runs):
        r = np.asarray(runs, dtype=np.int64)
        np.add.at(step, r[0::2], 1)
        np.add.at(step, r[1::2], -1)
    return np.cumsum(step[:total]) > 0


def with_runs(docs: DataFrame, runs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """``doc_id, packed, runs`` of every document row."""
    return (docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"),
                        packed(F.col(text)).alias("packed"))
                .join(runs, "row_key", "left").select("doc_id", "packed", "runs"))
