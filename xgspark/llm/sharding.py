"""Sharding by a hierarchical weighted hash tree.

A layout is a tree of regions, racks and shards with a weight per shard; a
node weighs what its shards weigh.  A key descends from the root: at every
level each child draws ``-ln(u) / weight`` with ``u`` hashed from the key and
the child's name, and the smallest draw wins.  A child's draw depends on its
own name and weight alone, so changing weights moves keys only into or out of
the subtrees whose weights change, and in proportion.

Law of the registered query: ``key``.  The id and the shard count decide; a
new shard is added as a region of its own, so it takes rows from the others
and no row moves between old shards.

Scale: the shard is a column expression (a literal layout, no join, no
shuffle).  Slots number the rows of a shard without gaps: identical rows are
counted together first, then rows are ranked within 4,096 hash ranges of a
shard, whose counts give the offsets; no shard is ever sorted in one task.

Edge cases: a null id is the empty key; a null text has no bytes; repeated
rows get neighbouring slots of one shard; an empty table gives an empty table;
extra columns are kept by :func:`with_shard`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
RACKS_PER_REGION = 3
SHARDS_PER_RACK = 4
RANGE_DIGITS = 3          # hex digits of the hash range: 4,096 ranges a shard
ROW_BYTES = 8             # counted for each row beside its text


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(n: int = SHARDS) -> list[Leaf]:
    """``n`` shards of equal weight: up to ``SHARDS`` in racks of 4 and regions
    of 3 racks; every further one is grown, so a count has one tree however it
    was reached from there."""
    if n > SHARDS:
        return grow(layout(n - 1))
    out = []
    for s in range(n):
        rack = s // SHARDS_PER_RACK
        out.append(Leaf(f"g{rack // RACKS_PER_REGION}", f"k{rack}", s))
    return out


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, as a region of its own: no other subtree changes weight."""
    s = 1 + max((x.shard for x in leaves), default=-1)
    return [*leaves, Leaf(f"g-new{s}", f"k-new{s}", s, weight)]


def uniform(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of a text."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
            .cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _children(leaves: list[Leaf], of) -> dict[str, list[tuple[str, float]]]:
    """Parent name -> [(child name, weight)] for one level of the tree."""
    weights: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        parent, child = of(leaf)
        level = weights.setdefault(parent, {})
        level[child] = level.get(child, 0.0) + leaf.weight
    return {p: [(c, w) for c, w in sorted(level.items()) if w > 0] for p, level in weights.items()}


def _draw(key: Column, children: Column) -> Column:
    """Name of the child with the smallest weighted draw."""
    return F.array_min(F.transform(children, lambda c: F.struct(
        (-F.ln(uniform(F.concat(key, F.lit("|"), c["name"]))) / c["weight"]).alias("draw"),
        c["name"].alias("name"))))["name"]


def _literal(children: dict[str, list[tuple[str, float]]]) -> Column:
    pairs = []
    for parent, nodes in children.items():
        pairs += [F.lit(parent), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight"))
                                           for c, w in nodes])]
    return F.create_map(*pairs)


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """Shard of a key (any type; null is the empty key)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    levels = (_children(leaves, lambda x: ("", x.region)),
              _children(leaves, lambda x: (x.region, x.rack)),
              _children(leaves, lambda x: (x.rack, str(x.shard))))
    node: Column = F.lit("")
    for level in levels:
        node = _draw(text, F.element_at(_literal(level), node))
    return node.cast("int")


def with_shard(docs: DataFrame, leaves: list[Leaf], *, doc_id: str = "doc_id", name: str = "shard") -> DataFrame:
    """All columns plus the shard; ``name`` must not be taken."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {name} exists; pass another name")
    return docs.withColumn(name, shard_of(F.col(doc_id), leaves))


def place(docs: DataFrame, leaves: list[Leaf], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              "text_crc32", "size").cast("binary"))
    rows = (rows.withColumn("shard", shard_of(F.col("doc_id"), leaves))
                .withColumn("grown_shard", shard_of(F.col("doc_id"), grow(leaves)))
                .withColumn("order", order)
                .withColumn("range", F.substring("order", 1, RANGE_DIGITS)))
    inside = Window.partitionBy("shard", "range").orderBy("order", F.col("doc_id").asc_nulls_first())
    rows = rows.withColumn("before", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    sizes = rows.groupBy("shard", "range").agg(F.sum("copies").alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "range", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    first = F.col("offset") + F.coalesce("before", F.lit(0))
    return (rows.join(offsets, ["shard", "range"])
                .withColumn("slot", F.explode(F.sequence(first, first + F.col("copies") - 1)))
                .select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"))


def op9_sharding(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    placed = place(read_table(spark, sf_dir, "documents"), layout(SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"),
                         "shard", "slot", "grown_shard")


# ------------------------------------------------------------------ DuckDB oracle

def _pick_sql(key: str, nodes: list[tuple[str, float]]) -> str:
    """Name of the node with the smallest draw (structs compare field by field)."""
    draws = []
    for name, weight in nodes:
        bits = f"CAST('0x' || substr(md5({key} || '|{name}'), 1, 13) AS BIGINT)"
        draws.append(f"{{'draw': -ln((CAST({bits} AS DOUBLE) + 0.5) / {float(1 << 52)!r}) / {float(weight)!r}, "
                     f"'name': '{name}'}}")
    return f"list_min([{', '.join(draws)}]).name"


def shard_sql(key: str, leaves: list[Leaf]) -> str:
    """SQL of :func:`shard_of` for a text expression: one CASE a level."""
    node = "''"
    for of in (lambda x: ("", x.region), lambda x: (x.region, x.rack), lambda x: (x.rack, str(x.shard))):
        branches = " ".join(f"WHEN '{p}' THEN {_pick_sql(key, nodes)}" for p, nodes in _children(leaves, of).items())
        node = f"(CASE {node} {branches} END)"
    return f"CAST({node} AS INTEGER)"


def oracle_sql() -> str:
    """SQL of the query's rows; CRC-32 is folded over the bytes of the text."""
    leaves = layout(SHARDS)
    key = "key"
    return f"""
WITH steps AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, key, len(h) // 2 + {ROW_BYTES} AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i:
           CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) AS crc
  FROM docs, steps),
placed AS (
  SELECT *, {shard_sql(key, leaves)} AS shard, {shard_sql(key, grow(leaves))} AS grown_shard FROM sized)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', key, crc, size)), doc_id NULLS FIRST) - 1 AS slot,
       grown_shard
FROM placed"""
