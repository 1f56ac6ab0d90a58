"""Answers of single-event and of versioned extractors to typed rows, and memories as the text that models get to see.

A broken event keeps its reason and its text and leaves its siblings alone. VARIANT expressions, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.constants import ACTIONS, ACTIVE_STATUSES, MEMORY_TYPES
from palimpsest.functions.text import json_object
from palimpsest.functions.time import lenient_anchor, resolve_phrase
from palimpsest.operators.parse import _first, _kind, _text, items
from palimpsest.operators.route_versioned import current_records

#: A label of evidence, as the extractor sees it.
LABEL = r"^e[0-9]+$"


def _given(kind: Column) -> Column:
    """Whether a field is there and isn't null."""
    return kind.isNotNull() & (kind != "VOID")


def _is(kind: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(kind.startswith(n), F.lit(False))
    return out


def single_events(answers: DataFrame) -> DataFrame:
    """(sample, batch, action, memory_type, key, value, status, event_date, qualifier, source, confidence, error, raw), one event for
    each answer (sample, batch, answer, source: JSON text of the default).

    The answer may stand in a fence or among other words. The status is active unless given, the source the default unless
    it is an object, the value any JSON, null too, but it must be there. NOOP needs nothing else. An answer that breaks a rule
    has ``error``, the first such rule, and nothing but its text; null and empty answers are ``no_object``."""
    v = F.col("_v")
    rows = answers.withColumn("_v", json_object("answer"))
    status = F.when(_kind(v, "$.status").isNull(), "active").otherwise(_text(v, "$.status"))
    source_kind, confidence_kind = _kind(v, "$.source"), _kind(v, "$.confidence")
    rows = rows.select(
        "sample", "batch", F.upper(_text(v, "$.action")).alias("action"), _text(v, "$.memory_type").alias("memory_type"), F.trim(_text(v, "$.key")).alias("key"),
        F.to_json(F.try_variant_get(v, "$.value", "variant")).alias("value"), status.alias("status"), _text(v, "$.event_date").alias("event_date"), _text(v, "$.qualifier").alias("qualifier"),
        F.when(_is(source_kind, "OBJECT"), F.to_json(F.try_variant_get(v, "$.source", "variant"))).otherwise(F.col("source")).alias("source"), F.col("source").alias("_default"),
        F.try_variant_get(v, "$.confidence", "double").alias("confidence"), _given(confidence_kind).alias("_rated"), v.isNotNull().alias("_object"), _kind(v, "$.value").isNotNull().alias("_valued"), F.col("answer").alias("raw"),
    )
    error = F.when(~F.col("_object"), "no_object").when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action")
    more = _first([
        (~F.col("memory_type").isin(*MEMORY_TYPES), "memory_type"), (~F.length("key").between(1, 256), "key"), (~F.col("_valued"), "value"),
        (~F.col("status").isin(*ACTIVE_STATUSES), "status"), (F.col("_rated") & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
    ])
    noop = F.coalesce(F.col("action") == "NOOP", F.lit(False))
    rows = rows.withColumn("error", F.coalesce(error, F.when(~noop, more)))
    good = F.col("error").isNull()
    plain = {"memory_type": F.lit("fact"), "key": F.lit("noop"), "status": F.lit("active"), "source": F.col("_default")}
    kept = [F.when(good & noop, plain.get(c, F.lit(None))).when(good, F.col(c)).alias(c) for c in ("memory_type", "key", "value", "status", "event_date", "qualifier", "source", "confidence")]
    return rows.select("sample", "batch", F.when(good, F.col("action")).alias("action"), *kept, "error", "raw")


def versioned_events(answers: DataFrame) -> DataFrame:
    """(sample, batch, item, op, record_type, key, semantic_status, attributes, time_expression, time_evidence_id, evidence_ids, target_ref,
    error, raw) of the events in versioned answers (sample, batch, answer).

    Attributes are a map to JSON text, null where unknown; evidence is given by number or label, repeats once. ``error`` is the
    first rule an event breaks. Answers without an array of events have no rows."""
    raw = F.col("raw")
    kind = lambda path: _kind(raw, path)
    rows = items(answers, "events", lenient=True)
    listed = F.try_variant_get(raw, "$.evidence_ids", "array<variant>")

    def number(x: Column, k: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        return F.when(k == "BIGINT", F.try_variant_get(x, "$", "bigint")).when((k == "STRING") & text.rlike(LABEL), F.substring(text, 2, 20).try_cast("bigint"))

    ids = F.transform(listed, lambda x: number(x, F.schema_of_variant(x)))
    named = F.try_variant_get(raw, "$.attributes", "map<string,variant>")
    values = F.transform_values(named, lambda _, x: F.nullif(F.to_json(x), F.lit("null")))
    timed, at_kind = _given(kind("$.time_expression")), kind("$.time_evidence_id")
    time_id = number(F.try_variant_get(raw, "$.time_evidence_id", "variant"), at_kind)
    op, target = F.upper(_text(raw, "$.op")), kind("$.target_ref")
    text_target = F.when(target == "STRING", _text(raw, "$.target_ref"))
    error = _first([
        (~F.schema_of_variant(raw).startswith("OBJECT"), "item"),
        (~op.isin("ADD", "PATCH", "REPLACE"), "unknown_op"),
        (~_text(raw, "$.record_type").isin(*MEMORY_TYPES), "unknown_record_type"),
        (~F.length(F.trim(_text(raw, "$.key"))).between(1, 256), "key_length"),
        (~_text(raw, "$.semantic_status").isin(*ACTIVE_STATUSES), "unknown_status"),
        (kind("$.attributes").isNotNull() & ~_is(kind("$.attributes"), "OBJECT"), "attributes"),
        (kind("$.attributes.amount").isNotNull() & ~_is(kind("$.attributes.amount"), "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "amount"),
        (kind("$.attributes.currency").isNotNull() & ~F.coalesce((kind("$.attributes.currency") == "STRING") & (F.trim(_text(raw, "$.attributes.currency")) != ""), F.lit(False)), "currency"),
        (F.coalesce(F.size(listed), F.lit(0)) < 1, "no_evidence"),
        (F.exists(ids, lambda i: i.isNull()), "evidence_form"),
        (timed & (kind("$.time_expression") != "STRING"), "time_expression"),
        (~timed & _given(at_kind), "time_evidence_without_time"),
        (timed & time_id.isNull(), "time_without_evidence"),
        ((op == "ADD") & _given(target), "add_with_target"),
        ((op != "ADD") & (F.coalesce(text_target, F.lit("")) == ""), "no_target"),
    ])
    rows = rows.withColumn("error", error)
    fields = {
        "op": op, "record_type": _text(raw, "$.record_type"), "key": F.trim(_text(raw, "$.key")), "semantic_status": _text(raw, "$.semantic_status"),
        "attributes": F.coalesce(values, F.create_map().cast("map<string,string>")), "time_expression": F.when(timed, _text(raw, "$.time_expression")), "time_evidence_id": time_id,
        "evidence_ids": F.array_distinct(ids), "target_ref": text_target,
    }
    kept = [F.when(F.col("error").isNull(), c).alias(n) for n, c in fields.items()]
    return rows.select("sample", "batch", F.col("item").cast("long").alias("item"), *kept, "error", F.to_json("raw").alias("raw"))


def grounded(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """``versioned_events`` as ``route_versioned`` takes them, held against the evidence of their batch (sample, batch,
    evidence_id, ref, session_date): whether every number is known, what it refers to, and the date that a time expression has in
    the session of its evidence. Evidence ids are unique in a batch."""
    known = evidence.groupBy(F.col("sample").alias("_s"), F.col("batch").alias("_b")).agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", F.struct("ref", "session_date")))).alias("_known"))
    rows = events.join(known, F.col("sample").eqNullSafe(F.col("_s")) & (F.col("batch") == F.col("_b")), "left").drop("_s", "_b")
    of = lambda i: F.try_element_at("_known", i)
    ids = F.coalesce("evidence_ids", F.array().cast("array<bigint>"))
    there = F.filter(ids, lambda i: of(i).isNotNull())
    at = of(F.col("time_evidence_id"))
    has_time = F.col("time_expression").isNotNull()
    date = F.when(has_time, resolve_phrase(F.col("time_expression"), F.to_date(lenient_anchor(at["session_date"]))))
    return rows.select(
        "sample", "batch", "item", "op", "record_type", "key", "semantic_status", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        has_time.alias("has_time"), (~has_time | at.isNotNull()).alias("time_ok"), date.cast("string").alias("date"),
        ((F.size(there) == F.size(ids)) & (F.size(ids) > 0)).alias("evidence_ok"), F.transform(there, lambda i: of(i)["ref"]).alias("refs"), "target_ref", "error",
    )


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("k")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def versions_text(versions: DataFrame, with_refs: bool = False) -> DataFrame:
    """(sample, memory): the current records of each sample as JSON with what answers may use, fields by name and records in
    the order in which they were made; with their refs for a reconciler. Samples without current records have no row."""
    pairs = F.array_sort(F.map_entries("attributes"))
    attributes = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(p["key"]), F.lit(":"), F.coalesce(p["value"], F.lit("null")))), ","), F.lit("}"))
    parts = [F.concat(F.lit('{"attributes":'), attributes), F.when(F.col("date").isNotNull(), F.concat(F.lit('"date":'), _quoted(F.col("date")))), F.concat(F.lit('"key":'), _quoted(F.col("key")))]
    if with_refs:
        parts.append(F.concat(F.lit('"record_ref":'), _quoted(F.col("record_ref"))))
    parts += [F.concat(F.lit('"record_type":'), _quoted(F.col("record_type"))), F.concat(F.lit('"semantic_status":'), _quoted(F.col("semantic_status")), F.lit("}"))]
    # r-<batch>-<item>, then r-final-<n>
    place = [F.split("record_ref", "-")[i].try_cast("long") for i in (1, 2)]
    order = F.struct(F.coalesce(place[0], F.lit((1 << 63) - 1)).alias("b"), place[1].alias("i"), F.concat_ws(",", *parts).alias("t"))
    lists = current_records(versions).groupBy("sample").agg(F.array_sort(F.collect_list(order)).alias("rs"))
    return lists.select("sample", F.concat(F.lit('{"records":['), F.array_join(F.transform("rs", lambda r: r["t"]), ","), F.lit("]}")).alias("memory"))
