"""Distributed prefix sums: a range sort whose order is written down, sums of each part, and offsets from those."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.storage import materialize

#: Rows of one part of a range sort; the number of parts grows with the table, so that a part stays of this order.
PART_ROWS = 50_000
#: monotonically_increasing_id holds the partition above this bit and the row's place in it below.
PLACE_BITS = 33


def parts_for(df: DataFrame, rows: int) -> int:
    """The number of range parts for a table of ``rows`` rows."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def range_sorted(df: DataFrame, parts: int, *order: Column) -> DataFrame:
    """``df`` dealt to ``parts`` ranges of ``order`` and sorted in each. The row's place in the input is the last key, so
    that equal rows, however many, are split like any others."""
    tie = F.col("_tie").asc()
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    return placed.repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).drop("_tie")


def sums_before(df: DataFrame, parts: int, group: list[str], order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """``df`` with a column for each of ``sums`` (name: column): its sum over the rows of the same ``group`` that come
    earlier in ``order``.

    The rows are range-sorted by group and order and written with their place, so the order is fixed from then on. A part
    adds up by itself; what comes before a part follows from one row for each part and group (parts + groups at most), so
    a group that holds most rows is spread over many tasks."""
    by_group = [F.col(g).asc_nulls_last() for g in group]
    at = F.monotonically_increasing_id()
    rows = materialize(range_sorted(df, parts, *by_group, *order).withColumn("_at", at), label)
    rows = rows.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    earlier = (Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *group).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    in_order = Window.partitionBy(*group).orderBy("_part").rowsBetween(*earlier)
    offsets = totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        *[F.coalesce(F.sum(f"_{n}").over(in_order), F.lit(0)).alias(f"_{n}") for n in sums],
    )
    within = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(*earlier)
    summed = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()])
    same = [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]]
    return summed.join(offsets, reduce(Column.__and__, same)).select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
