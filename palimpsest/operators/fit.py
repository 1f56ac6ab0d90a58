"""Contexts that must fit a budget: the first limits under which a prompt fits, and as much of the recent tail as remains.

Texts are lines, and a prompt's size is the sum of its lines' sizes, by any counter that adds up over lines. Limits fall, so
sizes fall with them: each sample's choice is the first of its sizes that fits, all of which come from one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import token_count
from palimpsest.operators.select import meet
from palimpsest.session import written

#: A column of text to its size.
Counter = Callable[[Column], Column]


def _sized(rows: DataFrame, keep: list[str], size: Counter) -> DataFrame:
    return rows.select("sample", *keep, F.col("line"), F.coalesce(size(F.col("line")), F.lit(0)).cast("long").alias("tokens"))


def _placed(records: DataFrame, ledger: DataFrame, size: Counter) -> DataFrame:
    """Records and ledger lines with ``place``, from 1 for the newest of a sample and of a key; ties go by the line."""
    newest = Window.partitionBy("sample").orderBy(F.desc("seq"), "line")
    latest = Window.partitionBy("sample", "key").orderBy(F.desc("seq"), "line")
    r = _sized(records, ["seq"], size).select("sample", "seq", "line", "tokens", F.lit(True).alias("record"), F.row_number().over(newest).alias("place"))
    u = _sized(ledger, ["key", "seq"], size).select("sample", "seq", "line", "tokens", F.lit(False).alias("record"), F.row_number().over(latest).alias("place"))
    return r.unionByName(u)


def fitting_limits(prompts: DataFrame, records: DataFrame, ledger: DataFrame, limits: list[tuple[int, int]], budget: int, size: Counter = token_count) -> DataFrame:
    """(sample, choice from 1, records, updates, tokens, fits) for each sample of ``prompts`` (sample, fixed: the size of what is
    always there).

    ``records`` (sample, seq, line), ``ledger`` (sample, key, seq, line). Limits are (newest records of a sample, newest ledger
    lines of a key), neither growing. The first that fits is chosen, else the last one, and ``fits`` is false. Null lines
    count nothing; samples without records or ledger fit by what is fixed."""
    if not limits or any(b[0] > a[0] or b[1] > a[1] for a, b in zip(limits, limits[1:], strict=False)):
        raise ValueError("limits must be given, and none may grow")
    return _choices(prompts, _placed(records, ledger, size), limits, budget)


def _choices(prompts: DataFrame, placed: DataFrame, limits: list[tuple[int, int]], budget: int) -> DataFrame:
    def taken(n: tuple[int, int]) -> Column:
        return F.sum(F.when(F.col("place") <= F.when(F.col("record"), n[0]).otherwise(n[1]), F.col("tokens")).otherwise(0))

    sums = placed.groupBy("sample").agg(*[taken(n).alias(f"_{i}") for i, n in enumerate(limits)])
    named = sums.withColumnRenamed("sample", "_s")
    rows = prompts.select("sample", F.coalesce("fixed", F.lit(0)).cast("long").alias("_fixed")).join(named, F.col("sample").eqNullSafe(F.col("_s")), "left")
    total = [F.col("_fixed") + F.coalesce(F.col(f"_{i}"), F.lit(0)) for i in range(len(limits))]
    choice = F.coalesce(*[F.when(t <= budget, F.lit(i)) for i, t in enumerate(total)], F.lit(len(limits) - 1))
    rows = rows.withColumn("_i", choice).withColumn("tokens", F.element_at(F.array(*total), F.col("_i") + 1))
    of = [F.element_at(F.array(*[F.lit(n[k]) for n in limits]), F.col("_i") + 1).cast("long") for k in (0, 1)]
    return rows.select("sample", (F.col("_i") + 1).cast("long").alias("choice"), of[0].alias("records"), of[1].alias("updates"), "tokens", (F.col("tokens") <= budget).alias("fits"))


def newest_units(tail: DataFrame, room: DataFrame, size: Counter = token_count) -> DataFrame:
    """(sample, unit, line, tokens) of the whole newest units of a tail (sample, unit, place, line) that fit in each sample's
    ``room``: none is cut, and nothing before one that doesn't fit is taken."""
    rows = _sized(tail, ["unit", "place"], size)
    from_end = Window.partitionBy("sample").orderBy(F.desc("unit")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = rows.withColumn("_behind", F.sum("tokens").over(from_end))
    return meet(behind, room.select("sample", "room"), ["sample"]).filter(F.col("_behind") <= F.col("room")).select("sample", "unit", "place", "line", "tokens")


def fitted_context(
    prompts: DataFrame, records: DataFrame, ledger: DataFrame, tail: DataFrame, limits: list[tuple[int, int]], budget: int, size: Counter = token_count
) -> DataFrame:
    """(sample, choice, memory, ledger, tail, units, tokens, fits): the texts of the largest context that fits each sample's
    budget, trying limits in order and, for each, the tail from whole to none in whole units.

    Limits weigh more than the tail: the first that fits without a tail is taken, and the tail has what is left. A
    context that doesn't fit under the last limits has those and no tail. Lines stand oldest first."""
    placed = written(_placed(records, ledger, size), "fit")
    if not limits or any(b[0] > a[0] or b[1] > a[1] for a, b in zip(limits, limits[1:], strict=False)):
        raise ValueError("limits must be given, and none may grow")
    chosen = written(_choices(prompts, placed, limits, budget), "limits")
    kept = meet(placed, chosen.select("sample", "records", "updates"), ["sample"]).filter(F.col("place") <= F.when(F.col("record"), F.col("records")).otherwise(F.col("updates")))

    def text(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        lines = rows.filter("line is not null").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("ls"))
        return lines.select(F.col("sample").alias(f"_{name}"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias(name))

    last = newest_units(tail, chosen.filter("fits").select("sample", (F.lit(budget) - F.col("tokens")).alias("room")), size)
    counted = last.groupBy(F.col("sample").alias("_n")).agg(F.countDistinct("unit").alias("units"), F.sum("tokens").alias("_t"))
    out = chosen
    for part in (text(kept.filter("record"), ["seq"], "memory"), text(kept.filter("not record"), ["seq"], "ledger"), text(last, ["unit", "place"], "tail"), counted):
        out = out.join(part, F.col("sample").eqNullSafe(F.col(part.columns[0])), "left").drop(part.columns[0])
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("memory", "ledger", "tail")]
    return out.select("sample", "choice", *texts, F.coalesce("units", F.lit(0)).alias("units"), (F.col("tokens") + F.coalesce("_t", F.lit(0))).alias("tokens"), "fits")


def memory_then_tail(contexts: DataFrame, budget: int, reserve: int) -> DataFrame:
    """(sample, memory, tail, tail_tokens, fits) of contexts (sample, fixed, memory, tail): the memory is never cut; the tail keeps
    its last white-space tokens for which there is room beside the memory, the fixed part and the ``reserve`` of the answer.
    Without room for these ``fits`` is false and the tail empty. A tail that fits stays as it is; null texts are empty."""
    room = F.lit(budget - reserve) - F.coalesce("fixed", F.lit(0)) - token_count("memory")
    parts = F.filter(F.split(F.coalesce("tail", F.lit("")), r"\s+"), lambda w: w != "")
    rows = contexts.select("sample", F.coalesce("memory", F.lit("")).alias("memory"), F.coalesce("tail", F.lit("")).alias("tail"), parts.alias("_w"), room.alias("_room"))
    n = F.size("_w")
    last = F.array_join(F.slice("_w", F.greatest(F.lit(1), n - F.col("_room") + 1).cast("int"), F.greatest(F.lit(0), F.col("_room")).cast("int")), " ")
    cut = F.when(F.col("_room") <= 0, "").when(n <= F.col("_room"), F.col("tail")).otherwise(last)
    return rows.select("sample", "memory", cut.alias("tail"), F.greatest(F.lit(0), F.least(n, F.col("_room"))).cast("long").alias("tail_tokens"), (F.col("_room") >= 0).alias("fits"))
