"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges`` has columns u, v of one orderable type. Every round is written to the shared folder, so lineage stays
    short and a lost executor costs one round. A star centre with many neighbours is aggregated map-side; nothing of a
    component is gathered in one task.
    """
    now = materialize(edges.select("u", "v").filter("u <> v").distinct(), "cc")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        now = materialize(_small_star(_large_star(now)), "cc")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
