"""Registered queries that read extractors' answers, which Spark writes from the driver's events, up to the memory's text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import answers, route_versioned
from palimpsest.plans.catalogue import query
from palimpsest.session import table

_CENTS = "CAST(floor(abs(value) * 100) AS BIGINT)"


def _cents():
    return F.floor(F.abs("value") * 100).cast("long").cast("string")


@query(f"""WITH a AS (SELECT user_id AS sample, event_id AS batch, event_id, event_type, {_CENTS} AS cents, CASE WHEN event_id % 6 = 0 THEN 'NOOP' WHEN event_id % 6 = 1 THEN 'UPDATE' ELSE 'ADD' END AS action FROM events),
e AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'no_object' WHEN action = 'NOOP' THEN NULL WHEN event_id % 9 = 0 THEN 'memory_type' WHEN event_id % 10 = 7 THEN 'value' WHEN event_id % 13 > 10 THEN 'confidence' END AS error FROM a)
SELECT sample, batch, CASE WHEN error IS NULL THEN action END AS action, CASE WHEN error IS NULL THEN CASE action WHEN 'NOOP' THEN 'noop' ELSE 'user.' || event_type END END AS key,
CASE WHEN error IS NULL AND action <> 'NOOP' THEN '{{"cents":' || cents || '}}' END AS value,
CASE WHEN error IS NULL THEN CASE WHEN action <> 'NOOP' AND event_id % 4 = 0 THEN '{{"session_id":"s' || sample || '"}}' ELSE '{{"session_id":"default"}}' END END AS source, error FROM e""")
def single_answers(spark, sf_dir):
    """Answers with one event each: some fenced, some without an object, a value, a known type or a possible confidence."""
    n = F.col("event_id")
    fields = [
        F.concat(F.lit('"action": "'), F.when(n % 6 == 0, "noop").when(n % 6 == 1, "UPDATE").otherwise("ADD"), F.lit('"')),
        F.concat(F.lit('"memory_type": "'), F.when(n % 9 == 0, "thing").otherwise("fact"), F.lit('"')), F.concat(F.lit('"key": " user.'), "event_type", F.lit('"')),
        F.when(n % 10 != 7, F.concat(F.lit('"value": {"cents": '), _cents(), F.lit("}"))), F.concat(F.lit('"confidence": '), ((n % 13) / 10).cast("string")),
        F.when(n % 4 == 0, F.concat(F.lit('"source": {"session_id": "s'), F.col("user_id").cast("string"), F.lit('"}'))),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    answer = F.when(n % 17 == 0, "none found").when(n % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), n.alias("batch"), answer.alias("answer"), F.lit('{"session_id":"default"}').alias("source"))
    return answers.single_events(asked).select("sample", "batch", "action", "key", "value", "source", "error")


def _versioned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(answers, evidence): a user's day is a batch, its answer lists an ADD for each event, dated the day before."""
    n, day = F.col("event_id"), F.to_date("ts")
    item = F.concat(
        F.lit('{"op": "add", "record_type": "'), F.when(n % 9 == 0, "thing").otherwise("fact"), F.lit('", "key": "'), F.col("event_type"), F.lit('", "semantic_status": "active", "attributes": {"cents": '), _cents(),
        F.lit('}, "evidence_ids": ["e'), (n % 5).cast("string"), F.lit('"]'), F.when(n % 4 == 0, F.lit(', "time_expression": "yesterday", "time_evidence_id": 0}')).otherwise("}"),
    )
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.unix_date(day).cast("long").alias("batch"), n.alias("n"), item.alias("item"))
    listed = rows.groupBy("sample", "batch").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("x"))
    told = listed.select("sample", "batch", F.concat(F.lit('{"events": ['), F.array_join(F.transform("x", lambda x: x["item"]), ", "), F.lit("]}")).alias("answer"))
    date = F.date_format(F.date_from_unix_date(F.col("batch").cast("int")), "yyyy/MM/dd (EEE) 10:00")
    known = told.select("sample", "batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("evidence_id"), date.alias("session_date"))
    return told, known.withColumn("ref", F.concat(F.lit("u"), F.col("evidence_id").cast("string")))


_MADE = f"""v AS (SELECT *, event_id % 9 = 0 AS typeless, event_id % 5 = 4 AS ungrounded, user_id AS sample, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS batch, {_CENTS} AS cents FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY sample, batch ORDER BY event_id) - 1 AS item FROM v)"""


@query(f"WITH {_MADE} SELECT sample, batch, item, CASE WHEN typeless THEN 'unknown_record_type' END AS error, CASE WHEN NOT typeless THEN event_type END AS key, CASE WHEN NOT typeless THEN [event_id % 5] END AS evidence_ids FROM i")
def versioned_answers(spark, sf_dir):
    return answers.versioned_events(_versioned(spark, sf_dir)[0]).select("sample", "batch", "item", "error", "key", "evidence_ids")


@query(f"""WITH {_MADE} SELECT sample, '{{"records":[' || string_agg('{{"attributes":{{"cents":' || cents || '}}' || CASE WHEN event_id % 4 = 0 THEN ',"date":"' || strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d') || '"' ELSE '' END ||
',"key":"' || event_type || '","record_ref":"r-' || batch || '-' || item || '","record_type":"fact","semantic_status":"active"}}', ',' ORDER BY batch, item) || ']}}' AS memory FROM i WHERE NOT typeless AND NOT ungrounded GROUP BY 1""")
def versioned_memory(spark, sf_dir):
    """From answers to each user's memory as a reconciler sees it."""
    told, known = _versioned(spark, sf_dir)
    events = answers.grounded(answers.versioned_events(told), known)
    return answers.versions_text(route_versioned.version_records(events), with_refs=True)
