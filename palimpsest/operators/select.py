"""Exact selection by rank in groups of any size: histograms of a group's values close in on the rank, so that no task
sorts or holds a group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType

from palimpsest.session import written

#: Cells of a histogram, and how many values of a group may be left to be ranked in a window.
CELLS, AT_MOST = 1024, 10_000


def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys in which null meets null."""
    named = right.withColumnsRenamed({k: f"{k}_right" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_right")) for k in keys])
    return left.join(named, same).drop(*[f"{k}_right" for k in keys])


def _cell(at_floats: bool) -> Column:
    """The cell of ``_v`` between the group's finite ends, without an order being lost to rounding: each step grows with
    the value. Infinite values and NaN, the largest, have cells of their own."""
    if at_floats:
        away, span = F.col("_v") / 2 - F.col("_from") / 2, F.col("_to") / 2 - F.col("_from") / 2
    else:
        away, span = (F.col("_v") - F.col("_from")).cast("double"), (F.col("_to") - F.col("_from")).cast("double")
    ends = F.when(F.col("_v") == F.col("_to"), CELLS - 1).otherwise(0)  # a span too small for its type
    inside = F.when(span > 0, F.least(F.floor(F.try_divide(away, span) * CELLS), F.lit(CELLS - 1)).cast("int")).otherwise(ends)
    if not at_floats:
        return inside
    inf = float("inf")
    return F.when(F.isnan("_v"), CELLS + 1).when(F.col("_v") == inf, CELLS).when(F.col("_v") == -inf, -1).otherwise(inside)


def nth_values(rows: DataFrame, value: str, keys: list[str], rank: Callable[[DataFrame], DataFrame], at_most: int = AT_MOST) -> DataFrame:
    """(keys, value, below, n): the value at a rank of each group's sorted values, how many values lie strictly below it,
    and how many there are in all.

    ``rank`` gets the groups (keys, n) and adds ``k``, the rank from 0; groups whose ``k`` is null or outside 0 to n - 1 have no
    row. Values are numbers; null values don't count, NaN is the largest, null keys are a group, ties are one value. Each
    round counts, in ``CELLS`` cells between the ends of what is left of a group, and goes on with the cell that has the
    rank, until a single value is left or ``at_most`` of them, which are ranked. An empty table gives no rows. What comes
    in is written once, as several rounds read it."""
    kind = rows.schema[value].dataType
    at_floats = isinstance(kind, DoubleType | FloatType)
    if not at_floats and not isinstance(kind, IntegralType | DecimalType):
        raise ValueError(f"{value} is no number: {kind.simpleString()}")
    v = F.col(value).cast("double" if at_floats else "decimal(20,0)" if isinstance(kind, IntegralType) else kind)
    names = [f"_k{i}" for i in range(len(keys))] or ["_all"]
    groups = [F.col(k).alias(n) for k, n in zip(keys, names, strict=False)] or [F.lit(0).alias("_all")]
    data = written(rows.filter(F.col(value).isNotNull()).select(*groups, v.alias("_v")), "select")

    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v")) if at_floats else F.col("_v")
    ends = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min(finite).alias("_from"), F.max(finite).alias("_to")]
    # the caller's rank sees its own names
    sized = data.groupBy(*names).agg(*ends)
    back = dict(zip(names, keys, strict=False))
    asked = rank(sized.select(*[F.col(n).alias(k) for n, k in back.items()], F.col("_n").alias("n")))
    wanted = asked.select(*[F.col(k).alias(n) for n, k in back.items()], *([] if keys else [F.lit(0).alias("_all")]), F.col("k").cast("long").alias("_k"))
    state = meet(sized, wanted, names).filter((F.col("_k") >= 0) & (F.col("_k") < F.col("_n")))
    state = written(state.withColumn("_below", F.lit(0).cast("long")).withColumn("_all_n", F.col("_n")), "select")

    single = F.col("_lo").eqNullSafe(F.col("_hi"))
    is_open = ~single & (F.col("_n") > at_most)
    near = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    while not state.filter(is_open).isEmpty():
        left = meet(data, state.filter(is_open).drop("_n"), names).filter(near)
        cells = left.groupBy(*names, "_k", "_below", "_all_n", _cell(at_floats).alias("_cell")).agg(*ends)
        upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_cell"))  # CELLS + 3 rows of a group at most
        chosen = cells.withColumn("_before", upto - F.col("_n")).filter((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_n")))
        chosen = chosen.withColumn("_k", F.col("_k") - F.col("_before")).withColumn("_below", F.col("_below") + F.col("_before"))
        state = written(state.filter(~is_open).unionByName(chosen.drop("_cell", "_before")), "select")

    found = state.filter(single).select(*names, F.col("_lo").alias("_v"), "_below", "_all_n")
    rest = meet(data, state.filter(~single), names).filter(near)
    at, peers = Window.partitionBy(*names).orderBy("_v"), F.rank().over(Window.partitionBy(*names).orderBy("_v"))
    ranked = rest.withColumn("_at", F.row_number().over(at)).withColumn("_below", F.col("_below") + peers - 1).filter(F.col("_at") == F.col("_k") + 1)
    out = found.unionByName(ranked.select(*names, "_v", "_below", "_all_n"))
    return out.select(*[F.col(n).alias(k) for n, k in back.items()], F.col("_v").cast(kind).alias("value"), F.col("_below").alias("below"), F.col("_all_n").alias("n"))


def smallest(rows: DataFrame, key: str, stratum: str, seed: int, quotas: DataFrame, at_most: int = AT_MOST) -> DataFrame:
    """(key, stratum): of each stratum as many rows as ``quotas`` (stratum, quota) says, those with the smallest seeded
    SHA-256 of the key, the key at ties; repeated rows count each.

    The quota-th smallest leading 60 bits are selected first; rows below come along as they are read, and only rows at that
    very value, which share a hash, are ordered, equal ones as one row with a count."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    drawn = rows.select(F.col(key).alias("_key"), F.col(stratum).alias("stratum"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_h"))
    asked = quotas.select("stratum", F.col("quota").alias("_quota"))
    cuts = nth_values(drawn, "_h", ["stratum"], lambda g: meet(g, asked, ["stratum"]).withColumn("k", F.least("_quota", "n") - 1).drop("_quota"), at_most)
    cuts = meet(cuts, asked, ["stratum"]).withColumn("_left", F.col("_quota") - F.col("below")).select("stratum", F.col("value").alias("_cut"), "_left")
    met = written(meet(drawn, cuts, ["stratum"]).filter(F.col("_h") <= F.col("_cut")), "picked")
    below = met.filter(F.col("_h") < F.col("_cut")).select("_key", "stratum")
    full = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_key").cast("string")), 256)
    ties = met.filter(F.col("_h") == F.col("_cut")).groupBy("stratum", "_key", "_left").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("stratum").orderBy(full, "_key")) - F.col("_n")
    ties = ties.withColumn("_take", F.least(F.col("_n"), F.col("_left") - before)).filter("_take > 0")
    taken = ties.select("_key", "stratum", F.explode(F.sequence(F.lit(1), F.col("_take")))).select("_key", "stratum")
    return below.unionByName(taken).withColumnRenamed("_key", key)
