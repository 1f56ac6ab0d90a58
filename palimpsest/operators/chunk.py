"""Turn-preserving chunks under a token budget, and budgets that degrade until a prompt fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import rendered, token_count
from palimpsest.operators.stream import CONVERSATIONS, Stream, turn_units


def _packed(sizes: Column, budget: int) -> Column:
    """For each size in order the number of its chunk: a chunk takes whole units while they fit; a unit that is larger
    than the budget is a chunk of its own."""
    start = F.struct(F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["chunk"] >= 0) & (acc["used"] + n <= budget)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        return F.struct(chunk.alias("chunk"), F.when(fits, acc["used"] + n).otherwise(n).alias("used"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def chunk_units(stream: DataFrame, budget: int, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, unit, tokens, chunk) for every turn unit of every stream."""
    if budget < 1:
        raise ValueError("the budget must be 1 or more")
    rows = turn_units(stream, s).withColumn("tokens", token_count(rendered(s.role, s.text)))
    units = rows.groupBy(s.key, "unit").agg(F.sum("tokens").alias("tokens"))
    lists = units.groupBy(s.key).agg(F.array_sort(F.collect_list(F.struct("unit", "tokens"))).alias("us"))
    chunks = lists.withColumn("chunks", _packed(F.transform("us", lambda u: u["tokens"]), budget))
    zipped = F.explode(F.arrays_zip("us", "chunks")).alias("z")
    return chunks.select(s.key, zipped).select(s.key, F.col("z.us.unit").alias("unit"), F.col("z.us.tokens").alias("tokens"), F.col("z.chunks").alias("chunk"))


def chunk_pack(stream: DataFrame, budget: int, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, chunk, units, tokens): what each chunk holds."""
    return chunk_units(stream, budget, s).groupBy(s.key, "chunk").agg(F.count("*").alias("units"), F.sum("tokens").alias("tokens"))


def chunk_messages(stream: DataFrame, budget: int, s: Stream = CONVERSATIONS) -> DataFrame:
    """The messages with their unit and chunk, and ``evidence_id``: the place in the chunk, from 0."""
    from pyspark.sql import Window

    placed = turn_units(stream, s).join(chunk_units(stream, budget, s).select(s.key, "unit", "chunk"), [s.key, "unit"])
    local = Window.partitionBy(s.key, "chunk").orderBy(s.order)
    return placed.withColumn("evidence_id", (F.row_number().over(local) - 1).cast("long"))


def first_fitting(candidates: DataFrame, key: str, rank: str, size: str, budget: int) -> DataFrame:
    """Of ranked candidates per key the first whose size fits the budget, else the last one."""
    fits = F.col(size) <= budget
    choice = F.struct((~fits).alias("over"), F.when(fits, F.col(rank)).otherwise(-F.col(rank)).alias("by"))
    row = F.struct(*[c for c in candidates.columns if c != key])
    return candidates.groupBy(key).agg(F.min_by(row, choice).alias("r")).select(key, "r.*")


def degraded_limits(active_budget: int, ledger_budget: int) -> list[tuple[int, int]]:
    """(records, updates per key) to try in turn until a manager's prompt fits."""
    records, updates = max(0, active_budget // 80), max(0, ledger_budget // 160)
    halves = [(records >> k, updates) for k in range(4)]
    return [*halves, (records >> 4, updates >> 1), (0, 0)]
