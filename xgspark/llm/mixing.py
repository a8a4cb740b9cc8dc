"""Mixing sources to target weights by a multivariate-hypergeometric splitting
tree.

Sizes are words.  Sources weigh 5, 2, 1 by code point order (null last) and
share the size of the whole corpus; no target passes ``MAX_EPOCHS`` times its
source, the excess is shared again by weight.

Every source is one stream of words: its documents in the order of a hash of
their id, cut into blocks of ``BLOCK_WORDS`` (a document belongs to the block its
first word falls in), and the blocks drawn in a permuted order, a keyed hash of
their number.  The mix takes the first ``target`` words of what is drawn, read as
often as needed: whole epochs, then the blocks drawn first.  What is taken is
cut into blocks again; the number of blocks of a source is its exact quota.

The quotas are then split among the output shards by a binary tree: at each
node the left half of the shards receives a multivariate hypergeometric draw
of the node's quotas (source after source, each draw by inversion of the
hypergeometric distribution), the right half the rest.  So every shard has its
exact number of blocks, every source its exact quota, and the composition of
a shard is that of a random draw without replacement.  Within a source the
blocks are permuted by a keyed hash again and each shard takes the next ones:
disjoint by construction.  Inside a shard, copies are ordered by a hash.

DataFrame and SQL functions only.  Scale: stream positions are sums over
hash ranges of a source plus a running sum within a range, so a source with
most of the corpus is spread over ``4,096`` tasks' worth of ranges; rows equal
in source, id and size are counted together first.  Tree and quota tables have
one row per node, with one entry per source; after ``TREE_LEVELS`` levels the
nodes are dealt to many tasks.  Texts move once, and only in
:func:`mix_documents`.

Edge cases: a null or wordless text has size 0 and is never taken; sources of
size 0 have target 0; a null source is one source, weighed last; repeated rows
follow each other in the stream; one id and text under two sources are two
documents; texts of any length are counted whole and never cut; an empty table
gives an empty mix; extra columns are kept by :func:`mix_documents`, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xgspark.llm._frame import free_name, position
from xgspark.session import materialize

# FIXED VALUES: the weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 16_384
SHARD_BLOCKS = 512
RANGE_DIGITS = 3
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"

TREE_LEVELS = 10
LOG_FACTORIALS = tuple(math.lgamma(n + 1) for n in range(16))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_key(doc_id: str, text: str, source: str) -> Column:
    """A 128-bit key of a row's id, text and source; never null."""
    return F.concat(F.hex(F.xxhash64(F.col(doc_id), F.col(text), F.col(source))),
                    F.hex(F.xxhash64(F.lit(SEED), F.col(source), F.col(text), F.col(doc_id))))


# ------------------------------------------------------------------ targets

def targets(sized: DataFrame) -> DataFrame:
    """``sized(source, size, copies)`` -> one row per source: ``source,
    source_no, source_size, target``."""
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("bigint").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    rows = totals.withColumn("source_no", number).withColumn("weight", weight.cast("bigint"))
    # Sources in the order in which a rising share per unit of weight fills them.
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    filled = F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    left = F.sum("source_size").over(every) - MAX_EPOCHS * filled
    rows = rows.withColumn("left", left.cast("bigint")).withColumn("open", open_.cast("bigint"))
    # Full when its weight's share of what is left reaches the limit.
    full = F.col("left") * F.col("weight") >= MAX_EPOCHS * F.col("source_size") * F.col("open")
    rows = rows.withColumn("full", full)
    shared = F.min(F.when(~F.col("full"), F.struct((-F.col("open")).alias("o"), F.col("left").alias("l")))).over(every)
    target = F.when(F.col("full"), (MAX_EPOCHS * F.col("source_size")).cast("double")) \
              .otherwise((shared["l"] * F.col("weight")).cast("double") / (-shared["o"]).cast("double"))
    return rows.select("source", "source_no", "source_size", target.alias("target"))


# ------------------------------------------------------------------ streams

def streams(docs: DataFrame, *, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): every distinct row with its place in its source's
    stream, and the targets.

    rows: ``doc_id, row_key, source_no, size, copies, start, source_size,
    target, goal``; ``start`` is the stream position of the first of its equal
    copies, ``goal`` the words the mix takes from the source.
    """
    sized = materialize(
        docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"),
                    document_key(doc_id, text, source).alias("row_key"), word_count(F.col(text)).alias("size"))
            .groupBy("source", "doc_id", "row_key", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    sources = materialize(targets(sized), "mix-targets")
    order = F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = (sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
                 .drop("source").withColumn("order", order)
                 .withColumn("range", F.substring("order", 1, RANGE_DIGITS)))
    words = F.col("size") * F.col("copies")
    inside = Window.partitionBy("source_no", "range").orderBy("order", F.col("doc_id").asc_nulls_first(), "size", "row_key")
    before = F.coalesce(F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("source_no", "range").agg(F.sum(words).alias("words"))
    ahead = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source_no", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    rows = rows.withColumn("before", before).join(offsets, ["source_no", "range"])
    goal = F.floor(F.col("target") + F.lit(0.5)).cast("bigint")
    hashed = rows.select("doc_id", "row_key", "source_no", "size", "copies", "source_size", "target",
                         (F.col("offset") + F.col("before")).cast("bigint").alias("start"), goal.alias("goal"))
    return drawn(hashed), sources


def drawn(rows: DataFrame) -> DataFrame:
    """The rows with ``start`` in the order in which their blocks are drawn: the
    words of the blocks drawn before, then the place within the block."""
    rows = rows.withColumn("drawn_block", F.floor(F.col("start") / BLOCK_WORDS).cast("bigint"))
    blocks = rows.groupBy("source_no", "drawn_block").agg(F.sum(F.col("size") * F.col("copies")).alias("words"),
                                                          F.min("start").alias("first"))
    # Rows follow each other in the stream: a block holds what starts in it, from its first row on.
    draw = F.md5(F.concat_ws("|", F.lit(SEED), F.col("source_no").cast("string"), F.col("drawn_block").cast("string")).cast("binary"))
    blocks = materialize(blocks.withColumn("draw", draw).withColumn("range", F.substring("draw", 1, RANGE_DIGITS)), "mix-blocks")
    inside = Window.partitionBy("source_no", "range").orderBy("draw", "drawn_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("source_no", "range").agg(F.sum("words").alias("all"))
    ahead = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source_no", "range", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("offset"))
    moved = blocks.withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(offsets, ["source_no", "range"]) \
                  .select("source_no", "drawn_block", (F.col("offset") + F.col("before") - F.col("first")).alias("shift"))
    return rows.join(moved, ["source_no", "drawn_block"]).withColumn("start", (F.col("start") + F.col("shift")).cast("bigint")) \
               .drop("drawn_block", "shift")


def copies_of(rows: DataFrame) -> DataFrame:
    """One row per copy that the mix reads: ``copy`` (1 to ``copies``, of equal
    rows), ``epoch``, ``words`` taken of it and ``block``.  Rows never taken
    stay, with a null epoch."""
    at = F.col("start") + (F.col("copy") - 1) * F.col("size")
    last = F.floor((F.col("goal") - at - 1) / F.col("source_size")).cast("bigint")     # last epoch that reaches it
    epochs = F.when((F.col("size") > 0) & (F.col("goal") > at), F.sequence(F.lit(0).cast("bigint"), last))
    read = F.col("epoch") * F.col("source_size") + at
    return (rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
                .withColumn("epoch", F.explode_outer(epochs))
                .withColumn("words", F.least(F.col("size"), F.col("goal") - read))
                .withColumn("block", F.floor(read / F.lit(BLOCK_WORDS)).cast("bigint")))


# ------------------------------------------------------------------ the tree

def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _log_factorial(n: Column) -> Column:
    table = F.array(*[F.lit(v) for v in LOG_FACTORIALS])
    x = n.cast("double")
    series = (x * F.ln(x) - x + 0.5 * F.ln(x * (2 * math.pi)) + 1.0 / (12.0 * x)
              - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * x * x * x * x * x))
    return F.when(n < len(LOG_FACTORIALS), F.element_at(table, (F.least(n, F.lit(len(LOG_FACTORIALS) - 1)) + 1).cast("int"))) \
            .otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked among ``drawn`` of ``total``, by inversion of ``u`` in
    (0, 1); exact to double precision within ten deviations of the mean."""
    def spread(v):
        mean = v["n"] * v["k"] / F.greatest(v["t"], F.lit(1))
        sd = F.sqrt(F.greatest(mean * (1 - v["k"] / F.greatest(v["t"], F.lit(1))) * (v["t"] - v["n"])
                               / F.greatest(v["t"] - 1, F.lit(1)), F.lit(0.0)))
        low = F.greatest(F.lit(0), v["n"] - (v["t"] - v["k"]), (F.floor(mean - 10 * sd) - 2).cast("bigint"))
        high = F.least(v["n"], v["k"], (F.ceil(mean + 10 * sd) + 2).cast("bigint"))
        return F.struct(v["t"].alias("t"), v["k"].alias("k"), v["n"].alias("n"), v["u"].alias("u"),
                        low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    def invert(v):
        lf = _log_factorial
        rest = v["t"] - v["k"]
        first = F.exp(lf(v["k"]) - lf(v["low"]) - lf(v["k"] - v["low"])
                      + lf(rest) - lf(v["n"] - v["low"]) - lf(rest - v["n"] + v["low"])
                      - lf(v["t"]) + lf(v["n"]) + lf(v["t"] - v["n"]))

        def step(s, k):
            up = s["p"] * ((v["k"] - k) * (v["n"] - k)).cast("double") \
                / ((k + 1) * (rest - v["n"] + k + 1)).cast("double")
            below = s["c"] + s["p"]
            return F.struct(up.alias("p"), below.alias("c"),
                            F.when(s["r"].isNull() & (v["u"] < below), k).otherwise(s["r"]).alias("r"))

        start = F.struct(first.alias("p"), F.lit(0.0).alias("c"), F.lit(None).cast("bigint").alias("r"))
        return F.coalesce(F.aggregate(F.sequence(v["low"], v["high"]), start, step, lambda s: s["r"]), v["high"])

    state = F.struct(total.cast("bigint").alias("t"), marked.cast("bigint").alias("k"),
                     drawn.cast("bigint").alias("n"), u.alias("u"))
    return _let(_let(state, spread), invert)


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """``quotas(source_no, quota)`` -> ``shard, source_no, quota, before``:
    the exact quota of each source in each shard, and the quota of the source
    in the shards before it."""
    entry = F.struct("source_no", "quota")
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("q"), F.sum("quota").alias("all")) \
                 .select(F.lit(0).alias("a"), F.lit(shards).alias("b"), "q", "all")

    def capacity(shard: Column) -> Column:      # blocks of the shards before this one
        return F.floor(shard.cast("bigint") * F.col("all") / F.lit(shards)).cast("bigint")

    for level in range(max(0, math.ceil(math.log2(max(1, shards))))):
        if level == TREE_LEVELS:
            node = materialize(node.repartition("a"), "mix-tree")
        middle = F.floor((F.col("a") + F.col("b") + 1) / 2).cast("int")
        node = node.withColumn("m", middle).withColumn("n", capacity(F.col("m")) - capacity(F.col("a"))) \
                   .withColumn("t", F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x["quota"]))

        def draw(s, x):
            def after(k):
                return F.struct((s["t"] - x["quota"]).alias("t"), (s["n"] - k).alias("n"),
                                F.concat(s["left"], F.array(k)).alias("left"))
            u = _uniform(F.lit(SEED), F.col("a"), F.col("b"), x["source_no"])
            return _let(hypergeometric(s["t"], x["quota"], s["n"], u), after)

        empty = F.struct(F.col("t").cast("bigint").alias("t"), F.col("n").cast("bigint").alias("n"),
                         F.array().cast("array<bigint>").alias("left"))
        node = node.withColumn("left", F.aggregate("q", empty, draw, lambda s: s["left"]))

        def half(sign: int) -> Column:
            return F.zip_with("q", "left", lambda x, k: F.struct(
                x["source_no"].alias("source_no"),
                (k if sign else x["quota"] - k).alias("quota")))

        whole = F.col("b") - F.col("a") <= 1
        parts = F.when(whole, F.array(F.struct("a", "b", "q"))).otherwise(F.array(
            F.struct(F.col("a"), F.col("m").alias("b"), half(1).alias("q")),
            F.struct(F.col("m").alias("a"), F.col("b"), half(0).alias("q"))))
        node = node.select("all", F.explode(parts).alias("p")).select("all", "p.*")
    flat = node.select(F.col("a").alias("shard"), F.explode("q").alias("e")).select("shard", "e.*")
    ahead = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("before", F.coalesce(F.sum("quota").over(ahead), F.lit(0)))


def block_shards(sources: DataFrame) -> DataFrame:
    """``source_no, block, shard``: the shard that each block of the taken
    streams goes to."""
    quota = F.ceil(F.floor(F.col("target") + 0.5) / BLOCK_WORDS).cast("bigint")
    quotas = sources.select("source_no", quota.alias("quota")).filter("quota > 0")
    total = quotas.agg(F.sum("quota").alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total / SHARD_BLOCKS))
    split = materialize(split_quotas(quotas, shards), "mix-quotas").filter("quota > 0")
    ranks = split.select("source_no", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("quota") - 1)).alias("position"))
    # The blocks of a source in the order of a keyed hash: ranks found in many ranges.
    runs = quotas.select("source_no", "quota", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1, F.lit(4096).cast("bigint"))).alias("a"))
    blocks = runs.select("source_no", F.explode(F.sequence("a", F.least(F.col("a") + 4095, F.col("quota") - 1))).alias("block")) \
                 .withColumn("at", F.xxhash64(F.lit(SEED), "source_no", "block"))
    return position(materialize(blocks, "mix-ranks"), "source_no", "at", "block").join(ranks, ["source_no", "position"]) \
        .select("source_no", "block", "shard")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per copy in the mix (and one, with null epoch and shard, per row
    never taken): ``doc_id, row_key, source_no, size, copies, copy, start,
    source_size, target, epoch, words, shard, shard_order``."""
    rows, sources = streams(docs, doc_id=doc_id, text=text, source=source)
    order = F.xxhash64(F.lit(SEED), "shard", "row_key", "copy", "epoch")
    return (copies_of(rows).join(block_shards(sources), ["source_no", "block"], "left")
            .withColumn("shard_order", order)
            .select("doc_id", "row_key", "source_no", "size", "copies", "copy", "start", "source_size", "target",
                    "epoch", F.when(F.col("shard").isNotNull(), F.col("words")).alias("words"), "shard", "shard_order"))


def mix_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                  place: bool = False) -> DataFrame:
    """The documents of the mix, one row per copy, with the columns of ``docs``
    (plus ``mix_shard`` and ``mix_order`` when ``place``).

    No text is changed; a source's stream ends at the end of the copy nearest
    its target (of two as near, the later), so it is off by at most half of one
    document."""
    key, copy = free_name(docs, "row_key"), free_name(docs, "copy")
    mixed = mix(docs, doc_id=doc_id, text=text, source=source) \
        .filter(F.col("shard").isNotNull() & (2 * F.col("words") >= F.col("size")))
    taken = mixed.select(F.col("row_key").alias(key), F.struct("shard", "shard_order").alias(copy))
    rows = docs.withColumn(key, document_key(doc_id, text, source)).dropDuplicates([key])
    out = [F.col(f"`{c}`") for c in docs.columns]
    if place:
        out += [F.col(copy)["shard"].alias("mix_shard"), F.col(copy)["shard_order"].alias("mix_order")]
    return rows.join(taken, key).select(*out)


def op2_mixing(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    copies = mix(read_table(spark, sf_dir, "documents"))
    return (copies.groupBy("doc_id", "row_key", "source_no", "copy", "size", "source_size", "target")
                  .agg(F.coalesce(F.sum("words"), F.lit(0)).cast("bigint").alias("taken"))
                  .select("doc_id", "size", "source_size", "target", "taken"))


def oracle_sql() -> str:
    """DuckDB SQL of the query's rows."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source),
weighed AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][no % {len(WEIGHTS)} + 1] AS weight FROM totals),
filling AS (
  SELECT *, sum(source_size) OVER () - {MAX_EPOCHS} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY source_size / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
shared AS (SELECT *, rest * weight >= {MAX_EPOCHS} * source_size * open AS full_ FROM filling),
level AS (SELECT arg_max(rest, open) AS rest, max(open) AS open FROM shared WHERE NOT full_),
goals AS (
  SELECT s.source, s.source_size, s.no,
         CASE WHEN full_ THEN CAST({MAX_EPOCHS} * source_size AS DOUBLE)
              ELSE CAST(l.rest * weight AS DOUBLE) / CAST(l.open AS DOUBLE) END AS target
  FROM shared s CROSS JOIN level l),
hashed AS (
  SELECT d.doc_id, d.size, g.no, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source
           ORDER BY md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
blocks AS (SELECT no, pos // {BLOCK_WORDS} AS block, sum(size) AS words, min(pos) AS first FROM hashed GROUP BY ALL),
moved AS (
  SELECT no, block, coalesce(sum(words) OVER (PARTITION BY no
           ORDER BY md5(concat_ws('|', '{SEED}', CAST(no AS VARCHAR), CAST(CAST(block AS BIGINT) AS VARCHAR)))
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first AS shift FROM blocks),
placed AS (
  SELECT h.*, h.pos + m.shift AS start FROM hashed h JOIN moved m ON h.no = m.no AND h.pos // {BLOCK_WORDS} = m.block)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size * size
         + greatest(0, least(size, goal % source_size - start)) END AS BIGINT) AS taken
FROM placed"""
