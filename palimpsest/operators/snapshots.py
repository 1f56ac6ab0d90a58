"""Snapshots of key/value memory along the chain of a sample's batches.

Every batch of input has a chain hash that covers it and all before it, so two runs agree up to a batch exactly if their
hashes there are equal. What was routed up to that batch is kept, and only later batches are routed, with what their keys had
before them. The memory as of any batch, as records, as text and as a hash, follows from the routed events alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.constants import ACTIVE_STATUSES
from palimpsest.operators.route_kv import KEY, ORDER, records, route_batches
from palimpsest.operators.select import meet
from palimpsest.session import written

#: What a record of a state's text shows, in this order.
SHOWN = ("batch", "item", "key", "memory_type", "status", "value")


def input_chain(events: DataFrame) -> DataFrame:
    """(sample, batch, hash): for each batch of a sample the SHA-256 of the hash before it (empty for the first), a colon and
    the batch's digest, which is the SHA-256 of its events' digests in order; an event is its columns as JSON by name,
    nulls left out. Repeated events count each."""
    row = F.sha2(F.to_json(F.struct(*sorted(events.columns))), 256)
    rows = events.groupBy("sample", "batch").agg(F.array_sort(F.collect_list(F.struct("item", row.alias("d")))).alias("ds"))
    digests = rows.select("sample", "batch", F.sha2(F.array_join(F.transform("ds", lambda d: d["d"]), ""), 256).alias("hash"))

    def chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, before = object(), ""
        for frame in frames:
            out = []
            for sample, digest in zip(frame["sample"].astype(object).where(frame["sample"].notna(), None), frame["hash"], strict=True):
                before = hashlib.sha256(f"{before if sample == last else ''}:{digest}".encode()).hexdigest()
                last = sample
                out.append(before)
            yield frame.assign(hash=out)

    # a sample's batches pass one behind the other, however many there are
    return digests.repartition("sample").sortWithinPartitions("sample", "batch").mapInPandas(chained, digests.schema)


def agreed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(sample, upto): the last batch at which two chains agree; samples that differ from the start have no row."""
    return meet(now, before, ["sample", "batch", "hash"]).groupBy("sample").agg(F.max("batch").alias("upto"))


def resumed(events: DataFrame, routed: DataFrame, common: DataFrame, route: Callable[[DataFrame], DataFrame] = route_batches) -> DataFrame:
    """What ``route`` gives for all events, from what it gave before for those up to ``upto`` (``common``: sample, upto) and
    a run over the later ones.

    What a later event does depends on the first and on the last applied event of its key before it, so these two go along.
    A stored ``superseded_by`` beyond ``upto`` is forgotten; the last applied event of a key gets the one of the new run."""
    limits = written(common, "common")
    left = limits.withColumnRenamed("sample", "_s")
    later = events.join(left, F.col("sample").eqNullSafe(F.col("_s")), "left").filter(F.col("upto").isNull() | (F.col("batch") > F.col("upto"))).drop("_s", "upto")
    kept = meet(routed, limits, ["sample"]).filter(F.col("batch") <= F.col("upto"))
    kept = kept.withColumn("superseded_by", F.when(F.col("superseded_by.batch") <= F.col("upto"), F.col("superseded_by"))).drop("upto")
    touched = later.select(*KEY).distinct()
    up, down = (Window.partitionBy(*KEY).orderBy(*[f(c) for c in ORDER]) for f in (F.asc, F.desc))
    applied = meet(kept.filter("route_status = 'applied'"), touched, list(KEY))
    ends = applied.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).filter("_up = 1 or _down = 1")
    again = written(route(ends.select(*events.columns).withColumn("_old", F.lit(True)).unionByName(later.withColumn("_old", F.lit(False)))), "resumed")
    # of the two that went along only the last one's successor is new
    met = ends.filter("_down = 1").select(*KEY, *ORDER)
    newer = meet(again.filter("_old and superseded_by is not null"), met, [*KEY, *ORDER]).select(*KEY, *ORDER, F.col("superseded_by").alias("_next")).withColumnsRenamed({c: f"_{c}" for c in (*KEY, *ORDER)})
    same = F.lit(True)
    for c in (*KEY, *ORDER):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    kept = kept.join(newer, same & (F.col("route_status") == "applied"), "left").withColumn("superseded_by", F.coalesce("_next", "superseded_by"))
    return kept.select(*routed.columns).unionByName(again.filter("not _old").select(*routed.columns))


def records_at(routed: DataFrame, at: DataFrame) -> DataFrame:
    """The memory of each (sample, at) as of batch ``at``: applied events up to it, superseded where the next one is also in
    it; the columns of ``records`` and ``at``."""
    there = meet(routed.filter("route_status = 'applied'"), at.select("sample", F.col("batch").alias("at")), ["sample"]).filter(F.col("batch") <= F.col("at"))
    return records(there.withColumn("superseded_by", F.when(F.col("superseded_by.batch") <= F.col("at"), F.col("superseded_by"))))


def states(routed: DataFrame, every: int = 1) -> DataFrame:
    """(sample, batch, state, state_hash, active): the memory as text with its SHA-256, and how many records are active,
    after every ``every``-th batch of a sample and after its last one. Batches that apply nothing count as well; a state
    without records has an empty list. All states of a sample hold its records again and again: a larger ``every`` stores
    fewer of them, and ``records_at`` gives any other."""
    if every < 1:
        raise ValueError("every must be 1 or more")
    w = Window.partitionBy("sample").orderBy("batch")
    batches = routed.select("sample", "batch").distinct().withColumn("n", F.row_number().over(w)).withColumn("_more", F.lead("batch").over(w).isNotNull())
    at = written(batches.filter(~F.col("_more") | (F.col("n") % every == 0)).select("sample", "batch"), "states")
    row = F.struct(*ORDER, F.struct(*SHOWN).alias("r"))
    memory = records_at(routed, at).groupBy("sample", F.col("at").alias("batch")).agg(F.array_sort(F.collect_list(row)).alias("rs"), F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active"))
    text = F.to_json(F.struct(F.transform("rs", lambda r: r["r"]).alias("records")))
    shown = memory.select("sample", "batch", text.alias("state"), "active").withColumnsRenamed({"sample": "_s", "batch": "_b"})
    out = at.join(shown, F.col("sample").eqNullSafe(F.col("_s")) & (F.col("batch") == F.col("_b")), "left")
    out = out.select("sample", "batch", F.coalesce("state", F.lit('{"records":[]}')).alias("state"), F.coalesce("active", F.lit(0)).cast("long").alias("active"))
    return out.select("sample", "batch", "state", F.sha2("state", 256).alias("state_hash"), "active")


def compaction_checks(wanted: DataFrame, compactions: DataFrame, memory: DataFrame) -> DataFrame:
    """(sample, outcome) for each wanted sample: ``reused`` if its stored compaction (sample, memory_hash, parse_status,
    summary) can be taken for its memory (sample, memory), else ``missing``, ``not_parsed`` or ``memory_changed``. Samples are unique
    in each table."""
    now = memory.select("sample", F.sha2("memory", 256).alias("_now"))
    rows = wanted.select("sample").join(compactions.withColumn("_stored", F.lit(True)), "sample", "left").join(now, "sample", "left")
    parsed = (F.col("parse_status") == "ok") & F.col("summary").isNotNull()
    outcome = F.when(F.col("_stored").isNull(), "missing").when(~F.coalesce(parsed, F.lit(False)), "not_parsed")
    return rows.select("sample", outcome.when(~F.col("memory_hash").eqNullSafe(F.col("_now")), "memory_changed").otherwise("reused").alias("outcome"))
