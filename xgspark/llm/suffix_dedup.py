"""Suffix-array dedup of long repeated byte strings, with linear grouping
construction of the suffix arrays.

Grouping construction sorts suffixes in two passes.  The first groups them by
their longest Lyndon prefix: groups are taken in descending order; every
suffix of a group points at its previous smaller suffix (the nearest one to
the left in a lower group), and the suffixes pointed at move to new groups
right behind their old ones, those pointed at more often further behind.  The
second emits the order: in ascending order, each finished suffix places the
suffixes whose next smaller suffix it is, at the next free slot of their
group.  Nothing is renamed, nothing recurses.

Here both passes run over many short texts at once: step by step, numpy takes
the highest unfinished group of every block (first pass) or the next slot of
every block (second pass).  A block holds the distinct candidate segments of
one anchor (see ``_repeats``), so blocks are small and independent; Spark
partitions and shuffles them.  A byte string of ``MATCH_BYTES`` is repeated
when its suffix has a neighbour in the array that shares that many bytes, or
its segment occurs more than once.

Edge cases: a null text is empty; texts shorter than a match lose nothing;
matches never cross texts, and are judged on the input; repeated rows are
copies of each other (all of their matches go); very long texts are cut into
overlapping pieces for the search only; an empty table gives an empty table;
extra columns are never looked at.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xgspark.llm._repeats import Bytes, merged, repeated, runs_of, unpack, with_runs

MATCH_BYTES = 200
GRAM_BYTES = 48
GATHER_BYTES = 8_000_000    # segments held by a task at once
BLOCK_BYTES = 600_000       # symbols sorted side by side


# ------------------------------------------------------------------ construction

def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All integers of ``[start, stop)`` ranges, one after the other."""
    n = stop - start
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - n - start, n)


def _group(text: np.ndarray, first: np.ndarray):
    """First pass.  ``text`` holds, for each block, one unused cell, its symbols
    (all above 0) and the end mark 0; block ``b`` is ``first[b]:first[b + 1]``.

    Returns ``(group, after, end)``: the first slot of each suffix's group, the
    position of its next smaller suffix, and the slot behind a group (by its
    first slot).
    """
    total = len(text)
    block = np.repeat(np.arange(len(first) - 1), np.diff(first))
    unused = first[:-1]
    used = np.ones(total, dtype=bool)
    used[unused] = False
    cells = np.flatnonzero(used)
    key = block[cells] * np.int64(512) + text[cells]
    order = cells[np.argsort(key, kind="stable")]
    slots = cells                                  # slot numbers are positions too
    at = np.full(total, -1)                        # slot -> suffix
    at[slots] = order
    slot = np.full(total, -1)                      # suffix -> slot
    slot[order] = slots
    sorted_key = np.sort(key, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    group = np.full(total, -1)
    sizes = np.diff(np.append(heads, len(cells)))
    group[order] = np.repeat(slots[heads], sizes)
    end = np.zeros(total, dtype=np.int64)          # first slot of a group -> slot behind it
    end[slots[heads]] = slots[heads] + sizes
    left, right = np.arange(total) - 1, np.arange(total) + 1
    after = np.full(total, -1)
    moving = np.zeros(total, dtype=bool)
    top, floor = first[1:].copy(), unused + 2      # slot unused + 1 is the end mark's
    while True:
        open_ = np.flatnonzero(top > floor)
        if not len(open_):
            return group, after, end
        low = group[at[top[open_] - 1]]
        members = np.sort(at[_ranges(low, top[open_])])
        top[open_] = low
        after[members] = right[members]
        head = np.ones(len(members), dtype=bool)
        head[1:] = left[members[1:]] != members[:-1]
        h = np.flatnonzero(head)
        count = np.diff(np.append(h, len(members)))
        before, behind = left[members[h]], right[members[h + count - 1]]
        right[before], left[behind] = behind, before
        old = group[before]
        split = np.flatnonzero((old >= 0) & (end[old] - old > 1))    # a group of one stays as it is
        if not len(split):
            continue
        p, count, old = before[split], count[split], old[split]
        o = np.lexsort((count, old))
        p, count, old = p[o], count[o], old[o]
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        g = np.flatnonzero(new_old)
        moved = np.diff(np.append(g, len(p)))
        stop = end[old[g]]
        target = np.arange(len(p)) - np.repeat(g - (stop - moved), moved)
        source = slot[p]
        moving[p] = True
        # Who stands in the way goes to a place left empty, group by group.
        standing = at[target]
        standing = standing[~moving[standing]]
        from_, to = np.repeat(stop - moved, moved), np.repeat(stop, moved)
        empty = source[(source < from_) | (source >= to)]
        moving[p] = False
        at[target], slot[p] = p, target
        at[empty], slot[standing] = standing, empty
        part = np.flatnonzero(new_old | np.concatenate(([True], count[1:] != count[:-1])))
        part_size = np.diff(np.append(part, len(p)))
        end[old[g]] = stop - moved
        end[target[part]] = target[part] + part_size
        group[p] = np.repeat(target[part], part_size)


def _emit(group: np.ndarray, after: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Second pass: the suffixes in order, block by block (cell ``first[b]``
    unused)."""
    total = len(group)
    out = np.full(total, -1)
    out[first[:-1] + 1] = first[1:] - 1            # the end mark comes first
    placed = np.flatnonzero(after >= 0)
    slots = group[placed]
    alone = end[slots] - slots == 1
    out[slots[alone]] = placed[alone]              # a group of one has its slot already
    placed = placed[~alone]
    by_next = placed[np.argsort(after[placed], kind="stable")]
    child_count = np.bincount(after[placed], minlength=total)
    child_end = np.cumsum(child_count)
    free = np.arange(total)
    longest = np.argsort(first[:-1] - first[1:], kind="stable")
    base, length = first[:-1][longest], np.diff(first)[longest]
    still = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    for t in range(1, len(still)):
        now = out[base[:still[t]] + t]
        count = child_count[now]
        some = np.flatnonzero(count)
        if not len(some):
            continue
        stop = child_end[now[some]]
        kids = by_next[_ranges(stop - count[some], stop)]
        g = group[kids]
        out[free[g]] = kids
        free[g] += 1
    return out


def suffix_arrays(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Suffix array of each block of non-negative symbols below 500."""
    first = np.concatenate(([0], np.cumsum([len(b) + 2 for b in blocks]))).astype(np.int64)
    text = np.zeros(first[-1], dtype=np.int64)
    for b, f in zip(blocks, first):
        text[f + 1:f + 1 + len(b)] = np.asarray(b, dtype=np.int64) + 1
    out = _emit(*_group(text, first), first)
    return [out[a + 2:b] - (a + 1) for a, b in zip(first, first[1:])]


# ------------------------------------------------------------------ matches

def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    wide = np.zeros(len(data), dtype=np.uint64)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    for j in range(8):
        wide |= padded[j:j + len(data)].astype(np.uint64) << np.uint64(8 * j)
    return wide


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether ``data[a:a + size] == data[b:b + size]``, for each pair."""
    wide = _words_at(data)
    alive = np.arange(len(a))
    steps = list(range(0, size - 7, 8)) + ([size - 8] if size % 8 else [])
    for j in steps:
        alive = alive[wide[a[alive] + j] == wide[b[alive] + j]]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def resolve(h: np.ndarray, s: np.ndarray, m: np.ndarray, bodies: list[bytes], size: int = MATCH_BYTES) -> list[list[int]]:
    """Repeated runs of each segment, from the suffix arrays of the blocks of
    equal ``h`` (rows sorted by it).  Blocks of like size are sorted side by
    side, as a step takes one group of every block that is left."""
    heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    stops = np.append(heads[1:], len(h))
    lengths = np.concatenate(([0], np.cumsum([len(x) for x in bodies])))
    sizes = lengths[stops] - lengths[heads]
    by_size = np.argsort(sizes, kind="stable")
    share = np.cumsum(sizes[by_size]) // BLOCK_BYTES
    out: list[list[int]] = [[] for _ in bodies]
    for part in np.split(by_size, np.flatnonzero(np.diff(share)) + 1):
        rows = _ranges(heads[part], stops[part])
        runs = _resolve(h[rows], m[rows], [bodies[i] for i in rows.tolist()], size)
        for i, r in zip(rows.tolist(), runs):
            out[i] = r
    return out


def _resolve(h: np.ndarray, m: np.ndarray, bodies: list[bytes], size: int) -> list[list[int]]:
    count = len(bodies)
    lengths = np.fromiter((len(x) for x in bodies), dtype=np.int64, count=count)
    heads = np.concatenate(([True], h[1:] != h[:-1]))
    # Layout: unused cell, then every segment followed by a mark (symbol 1);
    # the last mark of a block is its end (symbol 0).
    begin = np.cumsum(lengths + 1 + heads) - lengths - 1
    joined = b"".join(b"\0" + x + b"\0" if f else x + b"\0" for x, f in zip(bodies, heads.tolist()))
    data = np.frombuffer(joined, dtype=np.uint8)
    text = data.astype(np.int64) + 2
    ends = begin + lengths
    text[ends] = 1
    h_at = np.flatnonzero(heads)
    first = np.append(begin[h_at] - 1, len(data))
    text[first[1:] - 1] = 0
    order = _emit(*_group(text, first), first)

    windows = lengths - size + 1
    which = np.full(len(data), -1)                 # window start -> segment
    starts = _ranges(begin, begin + windows)
    which[starts] = np.repeat(np.arange(count), windows)
    order = order[order >= 0]
    order = order[which[order] >= 0]
    same = _same(data, order[:-1], order[1:], size)
    flag = np.zeros(len(data), dtype=bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    flag[starts] |= np.repeat(m > 1, windows)
    found = np.concatenate(([0], np.cumsum(flag)))
    found = found[begin + windows] - found[begin]
    return [[0, w + size - 1] if n == w else runs_of(flag[b:b + w], size) if n else []
            for b, w, n in zip(begin.tolist(), windows.tolist(), found.tolist())]


# ------------------------------------------------------------------ operator

def strip_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = MATCH_BYTES,
                  k: int = GRAM_BYTES) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the removed byte runs and the
    remaining bytes of every text."""

    def decide(h, s, m, bodies):
        return resolve(h, s, m, bodies, size)

    runs = repeated(docs, Bytes, size, k, decide, doc_id=doc_id, text=text, resolve_bytes=GATHER_BYTES)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for body, r in zip(unpack(batch["packed"]), batch["runs"]):
                sizes.append(len(body))
                if r is None:
                    spans.append([])
                    kept.append(body)
                    continue
                gone = merged(r, len(body))
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(body, dtype=np.uint8)[~gone].tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": sizes, "spans": spans, "kept": kept})

    id_type = docs.schema[doc_id].dataType.simpleString()
    return with_runs(docs, runs, doc_id=doc_id, text=text).mapInPandas(
        strip, f"doc_id {id_type}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def op4_suffix_dedup(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    got = strip_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
