"""Key/value memory routing in closed form: no state machine, two windows per key.

Events have ``sample, key, action, memory_type, value, status`` and an order (``batch, item``). Values are canonical
text; equal text is equal value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.constants import ACTIVE_STATUSES, KEY_DRIFT_SIMILARITY
from palimpsest.operators.similar import similar_pairs

KEY = ("sample", "key")
ORDER = ("batch", "item")


def _changes() -> Column:
    return F.col("action").isin("ADD", "UPDATE")


def _with_supersedes(routed: DataFrame) -> DataFrame:
    """Adds ``superseded_by`` (batch, item of the next applied event of the key)."""
    w = Window.partitionBy(*KEY, "_applied").orderBy(*ORDER)
    following = F.when(F.col("_applied"), F.lead(F.struct(*ORDER)).over(w))
    return routed.withColumn("superseded_by", following).drop("_applied")


def route_immediate(events: DataFrame) -> DataFrame:
    """Each event sees all before it. Adds ``route_status`` and ``superseded_by``.

    Of a key's changes in order, the first and every UPDATE are applied; another ADD is a duplicate if its value is the
    last applied one, else a conflict. UPDATE without a target is applied."""
    w = Window.partitionBy(*KEY, "_change").orderBy(*ORDER)
    rows = events.withColumn("_change", _changes())
    rows = rows.withColumn("_applied", F.col("_change") & ((F.col("action") == "UPDATE") | (F.row_number().over(w) == 1)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    current = F.last(F.when(F.col("_applied"), F.col("value")), ignorenulls=True).over(before)
    status = (
        F.when(~F.col("_change"), "noop").when(F.col("_applied"), "applied").when(current.eqNullSafe(F.col("value")), "deduplicated").otherwise("rejected_add_conflict")
    )
    return _with_supersedes(rows.withColumn("route_status", status)).drop("_change")


def duplicates_in_batch(events: DataFrame) -> DataFrame:
    """Adds ``duplicate``: the key changes more than once in the batch."""
    per_batch = Window.partitionBy("sample", "batch", "key", "_change")
    out = events.withColumn("_change", _changes())
    return out.withColumn("duplicate", F.col("_change") & (F.count("*").over(per_batch) > 1)).drop("_change")


def route_batches(events: DataFrame) -> DataFrame:
    """Each batch sees the state before it. Adds ``route_status`` and ``superseded_by``.

    Keys that change twice in a batch are rejected there. The key's first remaining ADD is applied and fixes its type;
    an UPDATE is applied if that ADD is in an earlier batch and the types agree. Other ADDs are duplicates of the current
    value, ambiguous (type event) or conflicts. Parse failures come with a ``reject`` status and pass it on."""
    rows = duplicates_in_batch(events)
    if "reject" not in rows.columns:
        rows = rows.withColumn("reject", F.lit(None).cast("string"))
    rows = rows.withColumn("_change", _changes() & ~F.col("duplicate") & F.col("reject").isNull())
    w = Window.partitionBy(*KEY, "_change").orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # one change of a key per batch is left, so rows before are batches before
    seen_type = F.first(F.when(F.col("action") == "ADD", F.col("memory_type")), ignorenulls=True).over(before)
    rows = rows.withColumn("_type", seen_type)
    first_add = (F.col("action") == "ADD") & F.col("_type").isNull()
    update = (F.col("action") == "UPDATE") & F.col("_type").eqNullSafe(F.col("memory_type"))
    rows = rows.withColumn("_applied", F.col("_change") & (first_add | update))
    current = F.last(F.when(F.col("_applied"), F.struct("value")), ignorenulls=True).over(before)
    add = F.when(current["value"].eqNullSafe(F.col("value")), "deduplicated").when(F.col("memory_type") == "event", "rejected_ambiguous_occurrence_key")
    status = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(F.col("duplicate"), "rejected_duplicate_key_in_batch")
        .when(~_changes(), "noop")
        .when(F.col("_applied"), "applied")
        .when(F.col("action") == "ADD", add.otherwise("rejected_add_conflict"))
        .when(F.col("_type").isNull(), "rejected_update_missing_target")
        .otherwise("rejected_update_type_mismatch")
    )
    return _with_supersedes(rows.withColumn("route_status", status)).drop("_change", "_type", "duplicate")


def with_key_drift(routed: DataFrame) -> DataFrame:
    """Adds ``drift_key`` to updates without a target and turns their status to ``rejected_key_drift`` where a key that
    was active before resembles theirs (ratio of matching blocks 0.82 or more; ties to the older key).

    Distinct keys of these updates meet distinct keys of their sample in a similarity join; events follow by their key."""
    lost = routed.filter("route_status = 'rejected_update_missing_target'").select("sample", "key", *ORDER)
    made = routed.filter("route_status = 'applied'").groupBy(*KEY).agg(F.min(F.struct(*ORDER)).alias("since"))
    made = made.withColumnRenamed("key", "candidate")
    alike = similar_pairs(lost.select("sample", F.col("key").alias("a")), made.select("sample", F.col("candidate").alias("b")), "sample", KEY_DRIFT_SIMILARITY)
    alike = alike.withColumnsRenamed({"a": "key", "b": "candidate"}).join(made, ["sample", "candidate"])
    pairs = lost.join(alike, ["sample", "key"]).filter(F.col("since.batch") < F.col("batch"))
    rank = F.struct(F.col("score"), -F.col("since.batch"), -F.col("since.item"))
    best = pairs.groupBy("sample", "key", *ORDER).agg(F.max_by("candidate", rank).alias("drift_key"))
    out = routed.join(best, ["sample", "key", *ORDER], "left")
    return out.withColumn("route_status", F.when(F.col("drift_key").isNotNull(), "rejected_key_drift").otherwise(F.col("route_status")))


def records(routed: DataFrame) -> DataFrame:
    """The memory after routing: applied events, ``superseded`` where a later one took their place."""
    kept = routed.filter("route_status = 'applied'")
    return kept.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))


def active_records(memory: DataFrame) -> DataFrame:
    return memory.filter(F.col("status").isin(*ACTIVE_STATUSES))


def update_ledger(memory: DataFrame, n: int = 2) -> DataFrame:
    """The last n superseded records of each key."""
    back = Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in ORDER])
    return memory.filter("status = 'superseded'").withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= n).drop("_k")


def last_records(memory: DataFrame, n: int) -> DataFrame:
    """The last n records of each sample."""
    back = Window.partitionBy("sample").orderBy(*[F.desc(c) for c in ORDER])
    return memory.withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= n).drop("_k")


def answer_memory(memory: DataFrame, with_superseded: bool = False) -> DataFrame:
    """(sample, memory): the records as JSON in order, without audit fields; null fields are left out."""
    shown = memory if with_superseded else active_records(memory)
    fields = [c for c in ("event_date", "key", "memory_type", "qualifier", "status", "value") if c in memory.columns]
    row = F.struct(*ORDER, F.struct(*fields).alias("r"))
    lists = shown.groupBy("sample").agg(F.array_sort(F.collect_list(row)).alias("rs"))
    return lists.select("sample", F.to_json(F.struct(F.transform("rs", lambda r: r["r"]).alias("records"))).alias("memory"))


def uncovered_amounts(evidence: DataFrame, events: DataFrame, amounts: Column) -> DataFrame:
    """(sample, evidence_id, amount): dollar amounts of user messages that no event with that evidence records.

    evidence: sample, evidence_id, role, text; events: sample, evidence_ids, amount (decimal)."""
    need = evidence.filter("role = 'user'").select("sample", "evidence_id", F.explode(amounts).alias("amount")).distinct()
    have = events.filter("amount is not null").select("sample", F.explode("evidence_ids").alias("evidence_id"), "amount")
    return need.join(have, ["sample", "evidence_id", "amount"], "left_anti")
