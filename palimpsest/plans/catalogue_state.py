"""Registered queries over snapshots of key/value memory and over contexts that must fit their budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.text import rendered
from palimpsest.operators import chunk, fit, route_kv, snapshots, stream
from palimpsest.plans.catalogue import _BATCHED, _EVENTS, _IMMEDIATE, _UNITS, _memory_events, query
from palimpsest.session import table

_ROUTED = f"""{_BATCHED}, r AS (SELECT *, CASE WHEN dup THEN 'rejected_duplicate_key_in_batch' WHEN action = 'NOOP' THEN 'noop' WHEN applied THEN 'applied'
  WHEN action = 'ADD' AND cur = value THEN 'deduplicated' WHEN action = 'ADD' AND memory_type = 'event' THEN 'rejected_ambiguous_occurrence_key' WHEN action = 'ADD' THEN 'rejected_add_conflict'
  WHEN t IS NULL THEN 'rejected_update_missing_target' ELSE 'rejected_update_type_mismatch' END AS route_status,
  CASE WHEN applied THEN lead(item) OVER (PARTITION BY sample, key, applied ORDER BY batch, item) END AS next_item,
  CASE WHEN applied THEN lead(batch) OVER (PARTITION BY sample, key, applied ORDER BY batch, item) END AS next_batch FROM q)"""


@query(f"""WITH RECURSIVE {_EVENTS}, d AS (
  SELECT sample, batch, sha256(string_agg(sha256('{{"action":"' || action || '","batch":' || batch || ',"item":' || item || ',"key":"' || key || '","memory_type":"' || memory_type || '","sample":' || sample || ',"status":"active","value":"' || value || '"}}'), '' ORDER BY item)) AS digest FROM ev GROUP BY 1, 2
), n AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY batch) AS k FROM d),
c AS (
  SELECT sample, batch, k, sha256(':' || digest) AS hash FROM n WHERE k = 1
  UNION ALL
  SELECT n.sample, n.batch, n.k, sha256(c.hash || ':' || n.digest) FROM c JOIN n ON n.sample = c.sample AND n.k = c.k + 1
) SELECT sample, batch, hash FROM c""")
def kv_input_chain(spark, sf_dir):
    return snapshots.input_chain(_memory_events(spark, sf_dir))


#: How many batches lie between two stored states.
EVERY = 5


@query(f"""WITH {_ROUTED}, b AS (SELECT sample, batch, row_number() OVER (PARTITION BY sample ORDER BY batch) AS k, lead(batch) OVER (PARTITION BY sample ORDER BY batch) AS more FROM (SELECT DISTINCT sample, batch FROM ev)),
goal AS (SELECT sample, batch AS upto FROM b WHERE k % {EVERY} = 0 OR more IS NULL), m AS (
  SELECT goal.sample, upto, r.batch, item, coalesce(next_batch <= upto, false) AS old,
    '{{"batch":' || r.batch || ',"item":' || item || ',"key":"' || key || '","memory_type":"' || memory_type || '","status":"' || CASE WHEN coalesce(next_batch <= upto, false) THEN 'superseded' ELSE 'active' END || '","value":"' || value || '"}}' AS row
  FROM goal JOIN r ON r.sample = goal.sample AND r.batch <= upto WHERE applied
), s AS (SELECT sample, upto, '{{"records":[' || string_agg(row, ',' ORDER BY batch, item) || ']}}' AS state, count(*) FILTER (NOT old) AS active FROM m GROUP BY 1, 2)
SELECT goal.sample, goal.upto AS batch, coalesce(state, '{{"records":[]}}') AS state, sha256(coalesce(state, '{{"records":[]}}')) AS state_hash, coalesce(active, 0) AS active FROM goal LEFT JOIN s ON s.sample = goal.sample AND s.upto = goal.upto""")
def kv_states(spark, sf_dir):
    return snapshots.states(route_kv.route_batches(_memory_events(spark, sf_dir)), EVERY)


@query(f"WITH {_ROUTED} SELECT sample, key, batch, item, route_status, next_item AS superseded_by FROM r")
def kv_resumed(spark, sf_dir):
    """A run over all events that goes on from a stored run over part of them: one without every user's last days, with other
    values from a day on for every third user. The rows are those of a full run."""
    events = _memory_events(spark, sf_dir)
    day = F.lit(19723) + F.pmod(F.col("sample"), F.lit(29))  # days of January 2024
    old = events.filter(F.col("batch") <= day + 14).withColumn("value", F.when((F.col("sample") % 3 == 0) & (F.col("batch") > day), F.lit("0")).otherwise(F.col("value")))
    common = snapshots.agreed(snapshots.input_chain(old), snapshots.input_chain(events))
    out = snapshots.resumed(events, route_kv.route_batches(old), common)
    return out.select("sample", "key", "batch", "item", "route_status", F.col("superseded_by.item").alias("superseded_by"))


#: Limits to try, and the budgets of a prompt and of an answer.
LIMITS, BUDGET, CONTEXT, RESERVE = chunk.degraded_limits(640, 480), 110, 90, 10

_LIMITS = ", ".join(f"({i}, {n}, {k})" for i, (n, k) in enumerate(LIMITS, 1))
_LISTED = f"""{_IMMEDIATE}, p AS (SELECT DISTINCT user_id AS sample, 5 + user_id % 60 AS fixed FROM events),
rec AS (SELECT sample, item, key || ' is ' || value || ' since ' || batch AS line, row_number() OVER (PARTITION BY sample ORDER BY item DESC) AS place FROM r WHERE applied AND superseded_by IS NULL),
led AS (SELECT sample, item, key || ' was ' || value AS line, row_number() OVER (PARTITION BY sample, key ORDER BY item DESC) AS place FROM r WHERE superseded_by IS NOT NULL),
lim(choice, nr, nu) AS (VALUES {_LIMITS}),
sz AS (
  SELECT sample, choice, nr, nu, fixed + coalesce((SELECT sum(len(string_split(line, ' '))) FROM rec WHERE rec.sample = p.sample AND place <= nr), 0)
    + coalesce((SELECT sum(len(string_split(line, ' '))) FROM led WHERE led.sample = p.sample AND place <= nu), 0) AS base FROM p, lim
), ch AS (SELECT * FROM sz WHERE base <= {BUDGET} OR choice = {len(LIMITS)} QUALIFY row_number() OVER (PARTITION BY sample ORDER BY choice) = 1)"""


def _listed(spark, sf_dir):
    """(prompts, records, ledger) from each user's memory."""
    memory = route_kv.records(route_kv.route_immediate(_memory_events(spark, sf_dir)))
    prompts = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample")).distinct().withColumn("fixed", 5 + F.col("sample") % 60)
    records = route_kv.active_records(memory).select("sample", F.col("item").alias("seq"), F.concat("key", F.lit(" is "), "value", F.lit(" since "), F.col("batch").cast("string")).alias("line"))
    ledger = memory.filter("status = 'superseded'").select("sample", "key", F.col("item").alias("seq"), F.concat("key", F.lit(" was "), "value").alias("line"))
    return prompts, records, ledger


@query(f"""WITH {_LISTED}, {_UNITS},
u AS (SELECT conv_id AS sample, unit, turn, line, sum(tokens) OVER (PARTITION BY conv_id ORDER BY unit DESC) AS behind, tokens FROM units),
tl AS (SELECT u.sample, string_agg(line, chr(10) ORDER BY unit, turn) AS tail, count(DISTINCT unit) AS units, sum(tokens) AS t FROM u JOIN ch ON ch.sample = u.sample WHERE behind <= {BUDGET} - base GROUP BY 1)
SELECT ch.sample, choice, coalesce((SELECT string_agg(line, chr(10) ORDER BY item) FROM rec WHERE rec.sample = ch.sample AND place <= nr), '') AS memory,
  coalesce((SELECT string_agg(line, chr(10) ORDER BY item) FROM led WHERE led.sample = ch.sample AND place <= nu), '') AS ledger,
  coalesce(tail, '') AS tail, coalesce(units, 0) AS units, CAST(base + coalesce(t, 0) AS BIGINT) AS tokens, base <= {BUDGET} AS fits FROM ch LEFT JOIN tl ON tl.sample = ch.sample""")
def context_fit(spark, sf_dir):
    """Each user's memory, ledger and the tail of the conversation of that number, under one budget."""
    talk = stream.turn_units(table(spark, sf_dir, "conversations"))
    tail = talk.select(F.col("conv_id").alias("sample"), "unit", F.col("turn").alias("place"), rendered("role", "text").alias("line"))
    return fit.fitted_context(*_listed(spark, sf_dir), tail, LIMITS, BUDGET)


@query(f"""WITH {_LISTED}, {_UNITS}, m AS (SELECT sample, string_agg(line, chr(10) ORDER BY item) AS memory, sum(len(string_split(line, ' '))) AS mt FROM rec GROUP BY 1),
tl AS (SELECT conv_id AS sample, string_agg(line, chr(10) ORDER BY turn) AS tail FROM units GROUP BY 1),
cx AS (SELECT p.sample, coalesce(memory, '') AS memory, coalesce(tail, '') AS tail, list_filter(regexp_split_to_array(coalesce(tail, ''), '\\s+'), lambda x: x <> '') AS ws, {CONTEXT - RESERVE} - fixed - coalesce(mt, 0) AS room
  FROM p LEFT JOIN m ON m.sample = p.sample LEFT JOIN tl ON tl.sample = p.sample)
SELECT sample, memory, CASE WHEN room <= 0 THEN '' WHEN len(ws) <= room THEN tail ELSE array_to_string(ws[-CAST(room AS BIGINT):], ' ') END AS tail, CAST(greatest(0, least(len(ws), room)) AS BIGINT) AS tail_tokens, room >= 0 AS fits FROM cx""")
def memory_then_tail(spark, sf_dir):
    """Each user's whole memory, and of the conversation of that number the last tokens for which there is room."""
    prompts, records, _ = _listed(spark, sf_dir)
    lines = records.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("memory"))
    tails = stream.transcripts(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("sample"), F.col("transcript").alias("tail"))
    return fit.memory_then_tail(prompts.join(lines, "sample", "left").join(tails, "sample", "left"), CONTEXT, RESERVE)
