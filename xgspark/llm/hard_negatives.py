"""Hard-negative mining by slot-decomposed selection.

Queries (*anchors*) are the rows whose id is divisible by ``ANCHOR_STEP``; they
are scored against all rows.  A score is the integer inner product of the
vectors' components ``floor(256 * x)``.  The positives of an anchor are its
first ``POSITIVES`` other rows of the same label (higher scores first, ties by
smaller id).  The negatives of a positive ``p`` are the first ``NEGATIVES``
rows of another label with ``50 * p <= 100 * score <= 95 * p``.

The windows of one anchor's positives overlap.  Their upper limits cut the
scores into disjoint slots; each row of another label falls into one slot, and
only the first ``NEGATIVES`` rows of a slot are kept, by block, then by task
(a rank limit before the shuffle), then overall.  The slots below a limit, in
descending order, hold the best rows below that limit: their suffixes, merged
once, answer every window, and the lower limit is applied last.

Scale: rows are packed into chunks of ``CHUNK_ROWS`` vectors and anchors into
blocks of ``BLOCK_ANCHORS``; a task takes one part of the chunks and one group
of the blocks (both bounded), multiplies them and returns at most
``POSITIVES + 1`` rows (second pass: ``NEGATIVES`` a slot) for an anchor and
chunk.  Nothing is broadcast or collected but row counts; hot labels or vectors
make no larger task, as parts are cut by position, not by value.

Products are exact: in doubles while every partial sum stays below 2**53, else
in Python integers, clipped to the range of a long.

Edge cases: rows with a null label, a null vector, or a component that is null
or not finite (also after multiplying by 256) take no part; a null id is an
id after all others, and null in the result; vectors of unlike length
are compared as if the shorter ended in zeros, an empty one scores 0; every row
is a row, repeated ones too: an anchor loses one row equal to itself, a
repeated anchor returns its rows once more.  Without anchors, positives or
negatives there are no rows.  Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xgspark.session import materialize

ANCHOR_STEP = 50
POSITIVES = 5
NEGATIVES = 3
LOWER_PERCENT = 50
UPPER_PERCENT = 95
CHUNK_ROWS = 8192
BLOCK_ANCHORS = 256
GROUP_BLOCKS = 16
LAST_ID = (1 << 63) - 1          # stands for a null id

_EXACT = 1 << 53
_LONG = (1 << 63) - 1
PACKED = "pack long, rows int, dims int, ids binary, labels binary, vectors binary"


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as whole doubles)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    size = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    gap = np.asarray(flat.is_null(), dtype=bool) if flat.null_count else np.zeros(len(flat), dtype=bool)
    values = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(256.0 * values)
    row = np.repeat(np.arange(n), size)
    bad = np.zeros(n, dtype=bool)
    bad[row[gap | ~np.isfinite(whole)]] = True
    bad |= np.asarray(column.is_null(), dtype=bool)
    dims = int(size.max()) if n else 0
    out = np.zeros((n, dims))
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = whole
    return ~bad, out[~bad]


def _pack(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    small = not vectors.size or np.abs(vectors).max() < 2 ** 31
    return {"rows": len(ids), "dims": vectors.shape[1], "ids": ids.tobytes(), "labels": labels.tobytes(),
            "vectors": vectors.astype(np.int32 if small else np.float64).tobytes()}


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = row.rows * row.dims
    kind = np.int32 if len(row.vectors) == 4 * cells else np.float64
    return (np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.labels, dtype=np.int64),
            np.frombuffer(row.vectors, dtype=kind).astype(np.float64).reshape(row.rows, row.dims))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``(id, label, vector)`` packed ``size`` at a time, ordered by id
    within a pack; ``pack`` numbers them within their table."""
    fields = pa.schema([("rows", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()),
                        ("labels", pa.binary()), ("vectors", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush():
            dims = max(h[2].shape[1] for h in held)
            ids = np.concatenate([h[0] for h in held])
            labels = np.concatenate([h[1] for h in held])
            vectors = np.concatenate([np.pad(h[2], ((0, 0), (0, dims - h[2].shape[1]))) for h in held])
            out = []
            for a in range(0, len(ids), size):
                order = np.argsort(ids[a:a + size], kind="stable") + a
                out.append(_pack(ids[order], labels[order], vectors[order]))
            return pa.RecordBatch.from_pylist(out, schema=fields)

        for b in batches:
            ok, vectors = _vectors(b.column("vector"))
            if not ok.any():
                continue
            held.append((np.asarray(b.column("id"))[ok], np.asarray(b.column("label"))[ok], vectors))
            count += int(ok.sum())
            if count >= size:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    out = rows.mapInArrow(pack, "rows int, dims int, ids binary, labels binary, vectors binary")
    return materialize(out.select(F.monotonically_increasing_id().alias("pack"), "*"), "packed-vectors")


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, one line an anchor; int64."""
    d = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :d], rows[:, :d]
    if not d:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    top = max(float(np.abs(a).max(initial=0)), 1.0) * max(float(np.abs(b).max(initial=0)), 1.0) * d
    if top < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T)
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def first_k(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the first ``k`` allowed cells of each line: higher
    scores first, then smaller columns."""
    lines, n = scores.shape
    take = min(k, n)
    lo = int(scores.min(initial=0))
    if (int(scores.max(initial=0)) - lo + 1) * (n + 1) < _LONG:
        # One number a cell, all different: the score, then the column.
        key = np.where(allowed, (scores - lo + 1) * n - np.arange(n), -np.arange(n) - 1)
        best = np.argpartition(key, n - take, axis=1)[:, n - take:] if take < n else \
            np.broadcast_to(np.arange(n), scores.shape)
        line = np.repeat(np.arange(lines), take)
        column = best.reshape(-1)
    else:
        best = [np.lexsort((np.arange(n), [-int(s) for s in row]))[:] for row in scores.astype(object)]
        pairs = [(i, c) for i, order in enumerate(best) for c in [x for x in order if allowed[i, x]][:k]]
        line, column = (np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    keep = allowed[line, column]
    return line[keep], column[keep]


def _grid(chunks: DataFrame, blocks: DataFrame, n_chunks: int, n_blocks: int):
    """Both tables dealt to the same cells ``(part, group)``: a chunk goes to
    every group of blocks, a block to every part of the chunks."""
    parts, groups = max(1, n_chunks), max(1, -(-n_blocks // GROUP_BLOCKS))
    def deal(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    left = chunks.withColumn("part", deal("pack", parts)) \
                 .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.withColumn("group", deal("pack", groups)) \
                  .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("part", "group").cogroup(right.groupBy("part", "group"))


FOUND = "block long, anchor int, slot int, score long, id long"


def _found(block, line, slot, scores, ids) -> pd.DataFrame:
    return pd.DataFrame({"block": np.full(len(line), block, dtype=np.int64), "anchor": line.astype(np.int32),
                         "slot": np.broadcast_to(np.int32(slot), len(line)), "score": scores, "id": ids})


def _none() -> pd.DataFrame:
    return _found(0, np.zeros(0, np.int32), 0, np.zeros(0, np.int64), np.zeros(0, np.int64))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank (a limit that Spark
    also applies within each task, before the shuffle)."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives_of(chunks: DataFrame, blocks: DataFrame, n_chunks: int, n_blocks: int, k: int) -> DataFrame:
    """``(block, anchor, rank, id, score, self_id)``: the first ``k`` other rows of an anchor's label."""
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [_none()]
        for chunk in left.itertuples():
            ids, labels, vectors = _unpack(chunk)
            for b in right.itertuples():
                own_ids, own_labels, own = _unpack(b)
                scores = _scores(own, vectors)
                line, column = first_k(scores, own_labels[:, None] == labels[None, :], k + 1)
                out.append(_found(b.pack, line, 0, scores[line, column], ids[column]))
        return pd.concat(out, ignore_index=True)

    found = _grid(chunks, blocks, n_chunks, n_blocks).applyInPandas(search, FOUND)
    top = _first(found, ["block", "anchor"], k + 1)

    def own_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for b in rows.itertuples():
                ids, _, v = _unpack(b)
                norm = np.concatenate([_scores(v[i:i + 1], v[i:i + 1])[0] for i in range(len(ids))])
                yield pd.DataFrame({"block": b.pack, "anchor": np.arange(len(ids), dtype=np.int32),
                                    "own_id": ids, "own_score": norm})

    own = blocks.mapInPandas(own_of, "block long, anchor int, own_id long, own_score long")
    # An anchor is itself among its rows once: one row with its id and its own score goes.
    twin = (F.col("id") == F.col("own_id")) & (F.col("score") == F.col("own_score"))
    keys = Window.partitionBy("block", "anchor")
    marked = top.join(own, ["block", "anchor"]).withColumn("self", F.min(F.when(twin, F.col("rank"))).over(keys))
    return (marked.filter("self is null or rank <> self")
                  .withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("self"), 1).otherwise(0))
                  .filter(F.col("rank") <= k)
                  .select("block", "anchor", "rank", "id", "score", F.col("own_id").alias("anchor_id")))


def _share(score, percent: int, up: bool):
    """``score * percent / 100``, rounded down or up, without overflow."""
    def whole(e: str) -> str:
        tens, ones = f"({e} div 100)", f"pmod({e}, 100)"
        floor = f"(({tens} - if({e} < 0 and {ones} <> 0, 1, 0)) * {percent} + cast(floor({ones} * {percent} / 100) as bigint))"
        return floor
    return F.expr(f"-{whole(f'(-{score})')}" if up else whole(score))


def slots_of(positives: DataFrame) -> DataFrame:
    """Positives with their window ``[lower, upper]`` and ``slot``: the number
    (from 0) of their upper limit among the anchor's distinct ones, descending."""
    limits = positives.withColumn("upper", _share("score", UPPER_PERCENT, False)) \
                      .withColumn("lower", _share("score", LOWER_PERCENT, True))
    return limits.withColumn("slot", F.dense_rank().over(
        Window.partitionBy("block", "anchor").orderBy(F.col("upper").desc())) - 1)


def negatives_in_slots(chunks: DataFrame, blocks: DataFrame, slots: DataFrame,
                       n_chunks: int, n_blocks: int, k: int) -> DataFrame:
    """``(block, anchor, slot, score, id, rank)``: the first ``k`` rows of
    another label in every slot of every anchor."""
    per_anchor = slots.groupBy("block", "anchor").agg(
        F.array_sort(F.collect_set("upper")).alias("uppers"), F.min("lower").alias("low"))
    limits = per_anchor.groupBy("block").agg(F.collect_list(F.struct("anchor", "uppers", "low")).alias("limits"))
    with_limits = blocks.join(limits, blocks["pack"] == limits["block"]).drop("block")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [_none()]
        for chunk in left.itertuples():
            ids, labels, vectors = _unpack(chunk)
            for b in right.itertuples():
                _, own_labels, own = _unpack(b)
                lines = np.array([x["anchor"] for x in b.limits], dtype=np.int64)
                low = np.array([x["low"] for x in b.limits], dtype=np.int64)
                uppers = [x["uppers"][::-1] for x in b.limits]
                scores = _scores(own[lines], vectors)
                other = (own_labels[lines][:, None] != labels[None, :]) & (scores >= low[:, None])
                for slot in range(max(map(len, uppers))):
                    has = np.array([len(u) > slot for u in uppers])
                    top = np.array([u[slot] if len(u) > slot else 0 for u in uppers], dtype=np.int64)
                    inside = other & has[:, None] & (scores <= top[:, None])
                    rest = [(i, u[slot + 1]) for i, u in enumerate(uppers) if len(u) > slot + 1]
                    if rest:
                        i, floor = np.array([r[0] for r in rest]), np.array([r[1] for r in rest], dtype=np.int64)
                        inside[i] &= scores[i] > floor[:, None]
                    line, column = first_k(scores, inside, k)
                    out.append(_found(b.pack, lines[line], slot, scores[line, column], ids[column]))
        return pd.concat(out, ignore_index=True)

    found = _grid(chunks, with_limits, n_chunks, n_blocks).applyInPandas(search, FOUND)
    return _first(found, ["block", "anchor", "slot"], k)


def hard_negatives(rows: DataFrame, *, row_id: str = "vec_id", label: str = "label", vector: str = "embedding",
                   step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    base = rows.select(F.coalesce(F.col(row_id).cast("long"), F.lit(LAST_ID)).alias("id"),
                       F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")) \
               .filter("label is not null and vector is not null")
    query = (F.col("id") % step == 0) & (F.col("id") != LAST_ID)
    sizes = base.agg(F.count(F.lit(1)).alias("rows"), F.count_if(query).alias("anchors")).first()
    n_chunks, n_blocks = -(-sizes["rows"] // CHUNK_ROWS), -(-sizes["anchors"] // BLOCK_ANCHORS)
    chunks = packed(base.repartition(max(1, n_chunks)), CHUNK_ROWS)
    blocks = packed(base.filter(query).repartition(max(1, n_blocks)), BLOCK_ANCHORS)
    top = materialize(slots_of(positives_of(chunks, blocks, n_chunks, n_blocks, positives)), "positives")
    best = negatives_in_slots(chunks, blocks, top, n_chunks, n_blocks, negatives)
    # At most `negatives` rows a slot: the slots of an anchor in descending order, and
    # what each suffix of them begins with, built from the last slot upwards.
    lists = best.groupBy("block", "anchor").agg(
        F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id")).alias("found"))
    suffixes = F.expr(f"""
        aggregate(sequence({positives - 1}, 0, -1), cast(array() as array<array<struct<slot:int,down:bigint,id:bigint>>>),
          (done, j) -> array_prepend(done, slice(concat(
            array_sort(filter(found, f -> f.slot = j)), coalesce(try_element_at(done, 1),
              cast(array() as array<struct<slot:int,down:bigint,id:bigint>>))), 1, {negatives})))""")
    merged = lists.select("block", "anchor", suffixes.alias("suffixes"))
    window = F.filter(F.col("suffixes")[F.col("slot")], lambda f: -f["down"] >= F.col("lower"))
    return (top.join(merged, ["block", "anchor"])
               .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                       F.posexplode(window).alias("rank", "n"))
               .select("anchor_id", F.nullif("positive_id", F.lit(LAST_ID)).alias("positive_id"),
                       (F.col("rank") + 1).cast("int").alias("rank"),
                       F.nullif("n.id", F.lit(LAST_ID)).alias("negative_id"), "positive_score",
                       (-F.col("n.down")).alias("negative_score")))


def embeddings_view(spark, sf_dir) -> DataFrame:
    """``embeddings`` with the labels of the contract (noise at ids divisible by 7)."""
    from xgspark.sources.tables import read_table

    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op11_hard_negatives(spark, sf_dir) -> DataFrame:
    """Contract rows: the hard negatives of every anchor and positive."""
    return hard_negatives(embeddings_view(spark, sf_dir))


def oracle_sql() -> str:
    """DuckDB SQL of the query's rows: all scores of the anchors, ranked."""
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS row, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256.0E0 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS arow, a.vec_id AS anchor_id, b.row, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM base a, base b WHERE a.vec_id % {ANCHOR_STEP} = 0 AND a.row <> b.row),
pos AS (
  SELECT arow, anchor_id, row AS prow, id AS positive_id, score AS ps FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY arow ORDER BY score DESC, id, row) <= {POSITIVES}),
neg AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.ps, s.score,
         row_number() OVER (PARTITION BY p.arow, p.prow ORDER BY s.score DESC, s.id, s.row) AS rank
  FROM pos p JOIN scored s ON s.arow = p.arow AND NOT s.same
   AND {LOWER_PERCENT} * p.ps <= 100 * s.score AND 100 * s.score <= {UPPER_PERCENT} * p.ps)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, ps AS positive_score, score AS negative_score
FROM neg WHERE rank <= {NEGATIVES}"""
