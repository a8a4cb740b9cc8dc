"""Connected components of a link table, as alternating star contractions.

Links and labels stay in Spark; each round is two joins, written once to the
shared folder, so a lost executor replays one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from xgspark.session import scratch_path


def _write(links: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Write a round; (table, fingerprint of its set of links)."""
    spark = links.sparkSession
    path = scratch_path(spark, name)
    seen = Observation(path)
    # The sum wraps by decimal width, not by value: 64-bit hashes of distinct links.
    marked = links.observe(seen, F.count(F.lit(1)).alias("n"),
                           F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"))
    marked.write.parquet(path)
    got = seen.get
    return spark.read.schema("u long, v long").parquet(path), (got["n"], got["s"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.filter("v > u").join(least, "u").filter("v <> m")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the smallest."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``links(u, v)`` of long node ids -> ``(node, root)`` for every linked
    node; ``root`` is the smallest node id of its component.

    Links of a node to itself are ignored; repeated links count once; no links
    give an empty table.
    """
    now, seen = _write(links.select("u", "v").filter("u <> v"), "links")
    if not seen[0]:
        return links.sparkSession.createDataFrame([], "node long, root long")
    for _ in range(max_rounds):
        now, mark = _write(_small_star(_large_star(now)), "star")
        if mark == seen:                      # stars only: u -> smallest
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
