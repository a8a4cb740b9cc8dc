"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 r`` bits apart share a variant: some 64-bit word
within ``r`` bits of both.  So every fingerprint emits all variants within
half the radius, rounded up (1 + 64 + 2016 for r = 2), variants are brought together by a
shuffle, and fingerprints that meet on a variant are linked.

Scale: variants are shuffled by a linear bucket code ``S(v)`` (parities of the
variant under fixed masks).  As ``S(f ^ flips) = S(f) ^ S(flips)``, the
sender knows which buckets a fingerprint's variants reach and sends the 8-byte
fingerprint once per bucket; the receiver expands the variants of its own
bucket, slice by slice (more parities of the same code), so its memory is
bounded by ``SLICE_VARIANTS`` however many fingerprints arrive.  Texts with
one fingerprint are collapsed before; fingerprints that meet on a variant are
chained, not paired with each other; each bucket sends on only a spanning
forest of its links.  Components are contracted in Spark.

Edge cases: null and empty texts and texts without a word have fingerprint 0,
linked like any other; fewer words than a shingle give one shingle of all
words; repeated rows and equal texts share a fingerprint; null document ids
are ignored when the smallest id of a component is taken (all null: null); an
empty table gives an empty table; other columns are never looked at.
"""

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xgspark.llm._components import components
from xgspark.llm._frame import free_name, row_key
from xgspark.llm._text import encode, mix64
from xgspark.session import materialize, materialize_counted

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42

BUCKET_VARIANTS = 16_000_000   # variants a bucket holds on average, at most
SLICE_VARIANTS = 1_000_000     # variants expanded in memory at once
MAX_BUCKET_BITS = 20


# ------------------------------------------------------------------ fingerprints

def _shingle_hashes(text: bytes, k: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.lower().split()
    if len(words) <= k:
        return [h(b" ".join(words), SEED)] if words else []
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    joined = b" ".join(words)
    starts = [0] + [e + 1 for e in ends[:len(words) - k]]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:])]


def fingerprints(texts: list[bytes], k: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit SimHash of each text, as unsigned words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, t in enumerate(texts):
        hashes = np.array(_shingle_hashes(t, k), dtype=">u8")
        if not len(hashes):
            continue
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 255):      # 255 ones fit an unsigned byte
            bits = np.unpackbits(hashes[at:at + 255].view(np.uint8).reshape(-1, 8), axis=1)
            ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
        out[i] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
    return out


def fingerprint(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of a text column as a (signed) long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints([encode(t) for t in texts], k).view(np.int64))

    return of(text)


# ------------------------------------------------------------------ ball hashing

def parity_masks(bits: int) -> np.ndarray:
    """Fixed masks of the bucket code, one per code bit."""
    return mix64(np.arange(1, bits + 1, dtype=np.uint64))


def flips(radius: int) -> np.ndarray:
    """All 64-bit words of at most ``radius`` ones."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for n in range(radius + 1)
                     for c in combinations(range(64), n)], dtype=np.uint64)


def code_of(words: np.ndarray, bits: int) -> np.ndarray:
    """Bucket code of each word: bit j is the parity of ``word & mask_j``."""
    out = np.zeros(len(words), dtype=np.int64)
    for j, mask in enumerate(parity_masks(bits)):
        out |= (np.bitwise_count(words & mask).astype(np.int64) & 1) << j
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return root


def bucket_links(prints: np.ndarray, bucket: int, bucket_bits: int, max_bits: int):
    """Spanning links ``(u, v)`` of the fingerprints that meet on a variant of
    this bucket.  ``prints`` are distinct."""
    n = len(prints)
    moves = flips((max_bits + 1) // 2)
    slice_bits = max(0, math.ceil(math.log2(max(1.0, n * len(moves) / 2 ** bucket_bits / SLICE_VARIANTS))))
    bits = bucket_bits + slice_bits
    code, move_code = code_of(prints, bits), code_of(moves, bits)
    by_code = np.argsort(code, kind="stable")
    classes, first = np.unique(code[by_code], return_index=True)
    last = np.append(first[1:], n)
    move_order = np.argsort(move_code, kind="stable")
    move_sorted = move_code[move_order]
    root = np.arange(n)
    for s in range(1 << slice_bits):
        want = bucket | (s << bucket_bits)
        lo = np.searchsorted(move_sorted, classes ^ want, "left")
        hi = np.searchsorted(move_sorted, classes ^ want, "right")
        variants, owners = [], []
        for c in np.flatnonzero(hi > lo):
            members = by_code[first[c]:last[c]]
            step = moves[move_order[lo[c]:hi[c]]]
            variants.append((prints[members][:, None] ^ step[None, :]).ravel())
            owners.append(np.repeat(members, len(step)))
        if not variants:
            continue
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        if max_bits % 2 == 0:
            order = np.argsort(variant)
            variant, owner = variant[order], owner[order]
            met = np.flatnonzero(variant[1:] == variant[:-1])
            a, b = owner[met], owner[met + 1]
        else:
            # Two at max_bits meet within max_bits // 2 bits of one of them: all
            # on a variant are linked to the nearest, if that is so near.
            away = np.bitwise_count(variant ^ prints[owner])
            order = np.lexsort((away, variant))
            variant, owner, away = variant[order], owner[order], away[order]
            heads = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
            head = np.repeat(heads, np.diff(np.append(heads, len(variant))))
            met = np.flatnonzero((away[head] <= max_bits // 2) & (head != np.arange(len(head))))
            a, b = owner[head[met]], owner[met]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= max_bits
        pairs = np.unique(root[a[near]] * np.int64(n) + root[b[near]])
        a, b = root[pairs // n], root[pairs % n]
        if len(a):
            root = _forest(n, np.concatenate((a, np.arange(n))), np.concatenate((b, root)))
    linked = np.flatnonzero(root != np.arange(n))
    return prints[linked], prints[root[linked]]


def links(prints: DataFrame, count: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints(fp)`` of distinct fingerprints -> links ``(u, v)`` that connect
    exactly the fingerprints reachable by steps of at most ``max_bits`` bits."""
    moves = flips((max_bits + 1) // 2)
    bits = min(MAX_BUCKET_BITS, max(3, math.ceil(math.log2(max(1.0, count * len(moves) / BUCKET_VARIANTS)))))
    code = F.lit(0)
    for j, mask in enumerate(parity_masks(bits).view(np.int64)):
        code = code.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(int(mask)))) % 2, j))
    reached = np.unique(code_of(moves, bits)).tolist()
    if len(reached) == 1 << bits:
        bucket = F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1)))
    else:
        bucket = F.explode(F.transform(F.array(*[F.lit(r) for r in reached]),
                                       lambda r: r.bitwiseXOR(F.col("code"))))
    sent = prints.select("fp", code.alias("code")).select("fp", bucket.alias("bucket"))

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        u, v = bucket_links(group["fp"].to_numpy().view(np.uint64), int(key[0]), bits, max_bits)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return sent.groupBy("bucket").applyInPandas(meet, "u long, v long").distinct()


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, row_key, fp, component_id)``, one row per document row;
    ``row_key`` is :func:`row_key` of the row."""
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"),
                                   fingerprint(F.col(text), k).alias("fp")), "fingerprints")
    distinct, count = materialize_counted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(distinct.select("fp"), count, max_bits))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
                     .select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = linked.select("fp", "root").join(smallest, "root")
    return rows.join(of_print, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group: the one with the smallest id (null last; of
    rows that share that id, the smallest row key; one of identical rows).
    All columns kept."""
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    key = free_name(docs, "row_key")
    kept = near_groups(docs, doc_id=doc_id, text=text, **options) \
        .groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.row_key").alias(key))
    return (docs.withColumn(key, row_key(doc_id, text)).join(kept, key)
                .dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns]))


def op6_simhash(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    got = near_groups(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
