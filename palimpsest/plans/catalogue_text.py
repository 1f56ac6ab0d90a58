"""Registered queries over question rows, model answers, routes of runs and audits, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import money
from palimpsest.functions.text import evidence_label, json_object
from palimpsest.functions.time import lenient_anchor, session_date
from palimpsest.operators import audit, evaluate, graph, manager, parse, project, route_kv, route_versioned, stream
from palimpsest.plans.catalogue import query
from palimpsest.session import fresh_path, table
from palimpsest.sources import files, store


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def _pick(*texts: str):
    """The text at the event's number modulo how many there are."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % len(texts) + 1).cast("int"))


# question rows ------------------------------------------------------------------------------------------------------

_SAMPLES = """s AS (SELECT DISTINCT conv_id, 'q' || CAST(conv_id % 50 AS VARCHAR) AS question_id, 1 + conv_id % 28 AS d FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, conv_id) - 1 AS session_index, row_number() OVER (PARTITION BY question_id ORDER BY conv_id) - 1 AS place FROM s),
m AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY session_index, turn) - 1 AS unit_ordinal, session_index, place, 's' || CAST(r.conv_id AS VARCHAR) AS session_id,
      '2023/05/' || lpad(CAST(d AS VARCHAR), 2, '0') || ' (Mon) 10:00' AS session_date, role, text AS content, row_number() OVER (PARTITION BY r.conv_id ORDER BY turn) AS message_index
      FROM r JOIN conversations c ON c.conv_id = r.conv_id)"""


def _samples(spark, sf_dir) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    sessions = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("ms"))
    date = F.concat(F.lit("2023/05/"), F.lpad((1 + F.col("conv_id") % 28).cast("string"), 2, "0"), F.lit(" (Mon) 10:00"))
    shown = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    rows = sessions.select("conv_id", date.alias("date"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), shown.alias("messages"))
    of = lambda c: F.transform("xs", lambda x: x[c])
    lists = rows.groupBy(F.concat(F.lit("q"), (F.col("conv_id") % 50).cast("string")).alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "date", "id", "messages"))).alias("xs"))
    return lists.select(
        "question_id", of("date").alias("haystack_dates"), of("id").alias("haystack_session_ids"), of("messages").alias("haystack_sessions"),
        F.array(of("id")[F.size("xs") - 1], F.lit("nowhere")).alias("answer_session_ids"),
    )


@query(f"WITH {_SAMPLES} SELECT question_id, unit_ordinal, session_index, session_id, role, content FROM m")
def sample_messages(spark, sf_dir):
    rows = stream.messages_of_samples(_samples(spark, sf_dir))
    return rows.select("question_id", F.col("unit_ordinal").cast("long").alias("unit_ordinal"), F.col("session_index").cast("long").alias("session_index"), "session_id", "role", "content")


@query(f"""WITH {_SAMPLES}, l AS (SELECT *, upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || content AS line, coalesce(lag(session_index) OVER (PARTITION BY question_id ORDER BY unit_ordinal) <> session_index, true) AS opens FROM m)
SELECT question_id, unit_ordinal, opens AS opens_session, CASE WHEN opens THEN '## Session ' || CAST(session_index + 1 AS VARCHAR) || ' — ' || session_date || chr(10) || line ELSE line END AS raw_text FROM l""")
def session_headers(spark, sf_dir):
    rows = stream.with_headers(stream.messages_of_samples(_samples(spark, sf_dir)))
    return rows.select("question_id", F.col("unit_ordinal").cast("long").alias("unit_ordinal"), "opens_session", "raw_text")


@query(f"WITH {_SAMPLES} SELECT question_id, count(DISTINCT session_id) AS sessions, count(*) AS messages, CAST(sum(length(content)) AS BIGINT) AS characters, CAST(2 AS BIGINT) AS answer_sessions FROM m GROUP BY 1")
def history_stats(spark, sf_dir):
    return evaluate.history_stats(_samples(spark, sf_dir))


@query(f"WITH {_SAMPLES} SELECT question_id, CAST(0 AS BIGINT) AS place, 's' || CAST(max(conv_id) AS VARCHAR) AS session_id, max(place) AS session_index FROM r GROUP BY 1 UNION ALL SELECT DISTINCT question_id, 1, 'nowhere', CAST(NULL AS BIGINT) FROM r")
def answer_sessions(spark, sf_dir):
    rows = audit.answer_sessions(_samples(spark, sf_dir))
    return rows.select("question_id", F.col("place").cast("long").alias("place"), "session_id", F.col("session_index").cast("long").alias("session_index"))


@query(f"""WITH {_SAMPLES}, h AS (SELECT question_id, place, session_index, min(message_index) AS first, count(*) AS n FROM m WHERE contains(content, 'e') AND message_index % 3 = 2 GROUP BY 1, 2, 3)
SELECT question_id, count(*) AS evidence_sessions, CAST(sum(n) AS BIGINT) AS evidence_messages, min(place) + 1 AS first_original, min(session_index) AS first_chronological,
count(*) FILTER ((first + 1) // 2 = 1) AS round_1, count(*) FILTER ((first + 1) // 2 = 2) AS round_2, count(*) FILTER ((first + 1) // 2 >= 3) AS round_3_plus FROM h GROUP BY 1""")
def evidence_diagnostics(spark, sf_dir):
    samples = _samples(spark, sf_dir).select("question_id", F.posexplode(F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_sessions").alias("ms"))).alias("place", "s"))
    original = samples.select("question_id", F.col("place").cast("long").alias("place"), F.col("s.id").alias("session_id"))
    rows = stream.messages_of_samples(_samples(spark, sf_dir)).join(original, ["question_id", "session_id"])
    w = stream.Window.partitionBy("question_id", "session_id").orderBy("unit_ordinal")
    n = F.row_number().over(w).cast("long")
    marked = rows.select("question_id", F.col("place").alias("session_index"), F.col("session_index").cast("long").alias("date_rank"), n.alias("message_index"), "content")
    marked = marked.withColumn("has_answer", F.contains("content", F.lit("e")) & (F.col("message_index") % 3 == 2))
    return evaluate.evidence_diagnostics(marked)


@query(f"WITH {_SAMPLES} SELECT question_id, unit_ordinal, list_filter(['^[A-M]', 'an', 'zzz'], lambda p: regexp_matches(content, p)) AS matched FROM m WHERE regexp_matches(content, '^[A-M]') OR contains(content, 'an')")
def matching_messages(spark, sf_dir):
    rows = audit.matching_messages(stream.messages_of_samples(_samples(spark, sf_dir)), ["^[A-M]", "an", "zzz"])
    return rows.select("question_id", F.col("unit_ordinal").cast("long").alias("unit_ordinal"), "matched")


@query(f"""WITH {_SAMPLES}, ev AS (SELECT question_id, unit_ordinal // 6 AS event_ordinal, string_agg(content, chr(10) ORDER BY unit_ordinal) AS input_text FROM m GROUP BY 1, 2)
SELECT m.question_id, m.unit_ordinal, CAST(e.event_ordinal AS BIGINT) AS event_ordinal, CASE WHEN m.unit_ordinal % 5 = 0 AND m.unit_ordinal // 6 = e.event_ordinal THEN 'source' ELSE 'text' END AS how FROM m JOIN ev e USING (question_id)
WHERE (m.unit_ordinal % 5 = 0 AND m.unit_ordinal // 6 = e.event_ordinal) OR (trim(m.content) <> '' AND contains(lower(e.input_text), lower(substr(trim(m.content), 1, 100))))""")
def matching_events(spark, sf_dir):
    messages = stream.messages_of_samples(_samples(spark, sf_dir)).withColumnRenamed("question_id", "sample").withColumn("unit_ordinal", F.col("unit_ordinal").cast("long"))
    row = F.struct("unit_ordinal", "content")
    chunks = messages.groupBy("sample", F.floor(F.col("unit_ordinal") / 6).alias("event_ordinal")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    said = F.array_join(F.transform("r", lambda m: m["content"]), "\n")
    units = F.filter(F.transform("r", lambda m: m["unit_ordinal"]), lambda u: u % 5 == 0)
    events = chunks.select("sample", "event_ordinal", said.alias("input_text"), units.alias("source_units"))
    return audit.matching_events(messages, events).withColumnRenamed("sample", "question_id")


@query("SELECT event_id, '[e' || CAST(event_id % 9 AS VARCHAR) || '][user] ' || event_type AS label FROM events")
def evidence_labels(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", evidence_label(F.col("event_id") % 9, F.lit("user"), F.col("event_type")).alias("label"))


@query("""WITH o AS (SELECT user_id AS sample, event_id // 8 AS batch, event_id, event_type, CAST(ts AS DATE) AS day FROM events),
l AS (SELECT *, coalesce(lag(day) OVER (PARTITION BY sample, batch ORDER BY event_id) <> day, true) AS fresh FROM o)
SELECT sample, batch, string_agg(CASE WHEN fresh THEN '## ' || CAST(day AS VARCHAR) || chr(10) ELSE '' END || '[e' || CAST(event_id AS VARCHAR) || '][user] ' || event_type, chr(10) ORDER BY event_id) AS chunk_text FROM l GROUP BY 1, 2""")
def labelled_chunks(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        F.col("user_id").alias("sample"), F.floor(F.col("event_id") / 8).alias("batch"), F.col("event_id").alias("evidence_id"), F.to_date("ts").alias("date"),
        F.lit("user").alias("role"), F.col("event_type").alias("content"),
    )
    return manager.labelled_chunks(rows)


# model answers ------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN 7 END AS lenient, CASE WHEN event_id % 5 IN (0, 1) THEN 7 END AS strict FROM events""")
def fenced_json(spark, sf_dir):
    answer = _pick('{"v": 7}', '```json\n{"v": 7}\n```', 'So: {"v": 7}, as asked.', "[7]", "nothing here")
    value = lambda lenient: F.try_variant_get(json_object(answer, lenient), "$.v", "int")
    return _events(spark, sf_dir).select("event_id", value(True).alias("lenient"), value(False).alias("strict"))


@query("SELECT event_id, event_id % 6 IN (1, 2, 4) AS cut FROM events")
def truncated_answers(spark, sf_dir):
    answer = _pick('{"claims": []}', '{"claims": [{"a": "b', '{"claims": [1,', "no json at all", '```json\n{"claims": [{}\n```', '{"a": "[{"}')
    return _events(spark, sf_dir).select("event_id", parse.is_truncated(answer).alias("cut"))


@query("""SELECT user_id AS sample, event_id AS batch, CAST(i.k AS BIGINT) AS item, CASE i.k WHEN 0 THEN CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE 'rejected_invalid_evidence' END
WHEN 1 THEN 'rejected_parse' WHEN 2 THEN NULL WHEN 3 THEN 'rejected_invalid_evidence' WHEN 4 THEN 'rejected_parse' END AS reject,
CASE i.k WHEN 0 THEN 'my.key' WHEN 1 THEN 'k' WHEN 3 THEN 'k' WHEN 4 THEN 'k' END AS key FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS k) i""")
def parsed_events(spark, sf_dir):
    item = lambda action, key, ids, status="active": (
        f'{{"action": "{action}", "key": "{key}", "memory_type": "fact", "value": 1, "status": "{status}", "source": {{"evidence_ids": {ids}}}}}'
    )
    parts = [item("add", " My__Key", "[%d]"), item("DROP", "k", "[1]"), '{"action": "NOOP"}', item("ADD", "k", '["1"]'), item("ADD", "k", "[1]", "gone")]
    answer = F.format_string('{"events": [' + ", ".join(parts) + "]}", F.col("event_id") % 4)
    answers = _events(spark, sf_dir).select(F.col("user_id").alias("sample"), F.col("event_id").alias("batch"), answer.alias("answer"))
    known = answers.select("sample", "batch", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("evidence_id"))
    return parse.memory_events(answers, known).select("sample", "batch", "item", "reject", "key")


@query("""SELECT user_id AS sample, event_id AS batch, CAST(k AS BIGINT) AS item, CASE k WHEN 0 THEN 'normalized' WHEN 1 THEN 'unknown_relation' ELSE 'incomplete' END AS parse_status,
CASE WHEN k = 0 THEN 'PURCHASED' END AS predicate, CASE WHEN k < 2 THEN CAST(CAST(floor(abs(value)) AS BIGINT) + 0.5 AS DOUBLE) END AS amount, CASE WHEN k < 2 THEN event_id % 40 END AS count,
CASE WHEN k < 2 THEN CAST(ts AS DATE) END AS day FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) i""")
def parsed_claims(spark, sf_dir):
    rows = _events(spark, sf_dir)
    whole = F.floor(F.abs("value")).cast("long").cast("string")
    said = F.concat(F.lit("I bought "), (F.col("event_id") % 40).cast("string"), F.lit(" books for $"), whole, F.lit(".50 on "), F.date_format("ts", "yyyy-MM-dd"))
    claim = lambda relation, ids: f'{{"subject_text": "I", "relation": "{relation}", "object_text": "books", "evidence_ids": {ids}}}'
    answer = f'{{"claims": [{claim("bought", "[1]")}, {claim("juggled", "[1]")}, {claim("bought", "[2]")}, {claim("bought", chr(91) + chr(34) + "1" + chr(34) + chr(93))}]}}'
    keyed = rows.select(F.col("user_id").alias("sample"), F.col("event_id").alias("batch"), F.to_date("ts").alias("date"), said.alias("content"))
    message = lambda n, role: keyed.select("*", F.lit(n).cast("long").alias("evidence_id"), F.lit(role).alias("role"), F.lit("s").alias("session"), F.col("batch").alias("unit"))
    cited = message(1, "user").unionByName(message(2, "assistant"))
    found = parse.claims(keyed.select("sample", "batch", F.lit(answer).alias("answer")), cited)
    right = F.col("item") < 2
    return found.select(
        "sample", "batch", "item", "parse_status", F.when(F.col("item") == 0, F.col("predicate")).alias("predicate"), F.when(right, F.col("amount").cast("double")).alias("amount"),
        F.when(right, F.col("count")).alias("count"), F.when(right, F.col("time.start")).alias("day"),
    )


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unknown_op' WHEN 2 THEN 'no_evidence' WHEN 3 THEN 'add_with_target' WHEN 4 THEN 'no_target' ELSE 'time_without_evidence' END AS error FROM events")
def validated_events(spark, sf_dir):
    k = F.col("event_id") % 6
    ids = F.when(k == 2, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(1).cast("long")))
    rows = _events(spark, sf_dir).select(
        "event_id", F.when(k == 1, "DROP").when(k == 4, "patch").otherwise("add").alias("op"), F.lit("fact").alias("record_type"), F.lit("k").alias("key"), F.lit("active").alias("semantic_status"),
        ids.alias("evidence_ids"), F.when(k == 5, "today").alias("time_expression"), F.lit(None).cast("long").alias("time_evidence_id"), F.when(k == 3, "r1").alias("target_ref"),
    )
    return route_versioned.validated(rows).select("event_id", "error")


@query("""SELECT event_id AS sample, CAST(o AS BIGINT) AS ordinal, CASE WHEN o = 0 THEN 'a,b' END AS refs, o = 1 AS bad FROM events, (SELECT unnest([0, 1]) AS o) x""")
def duplicate_groups(spark, sf_dir):
    answers = _events(spark, sf_dir).select(F.col("event_id").alias("sample"), F.lit('{"duplicate_groups": [{"record_refs": ["a", "b", "a"]}, {"record_refs": [""]}]}').alias("answer"))
    return manager.duplicate_groups(answers).select("sample", "ordinal", F.array_join("record_refs", ",").alias("refs"), F.col("error").isNotNull().alias("bad"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'short' END AS summary, CASE event_id % 4 WHEN 2 THEN 'yes' WHEN 0 THEN '{"summary_text": "short"}' WHEN 1 THEN '{"summary_text": "short", "more": 1}' ELSE 'plain words' END AS answer,
CASE WHEN event_id % 4 = 2 THEN 'e1' END AS evidence, CASE WHEN event_id % 4 = 3 THEN 5 END AS fallback FROM events""")
def read_answers(spark, sf_dir):
    text = _pick('{"summary_text": "short"}', '{"summary_text": "short", "more": 1}', '{"answer": "yes", "evidence": "e1"}', " plain words ")
    both = manager.answer_and_evidence(text)
    fallback = F.try_variant_get(manager.json_or(text, '{"n": 5}'), "$.n", "int")
    return _events(spark, sf_dir).select("event_id", manager.summary_of(text).alias("summary"), both["answer"].alias("answer"), both["evidence"].alias("evidence"), fallback.alias("fallback"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'We met.' WHEN event_id % 3 = 0 THEN 'I bought red shoes.' ELSE 'No match. None.' END AS sentence FROM events")
def best_sentence(spark, sf_dir):
    text, thing = _pick("We ate. I bought red shoes. Red it was.", "We met. Nothing else met it.", "No match. None."), _pick("red shoes", "met", "unseen words")
    found = parse.best_sentence(text, thing)
    return _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.regexp_replace(found, r"\.$", ""), F.lit("."))).when(F.col("event_id") % 3 == 1, F.concat(F.regexp_replace(found, r"\.$", ""), F.lit("."))).otherwise(found).alias("sentence"))


@query("SELECT event_id, CAST(event_id % 90 + 1 AS DOUBLE) AS amount FROM events")
def nearest_amount(spark, sf_dir):
    n = (F.col("event_id") % 90 + 1).cast("string")
    text = F.concat(F.lit("I paid $200 at Acme and then, much later on that day, $"), n, F.lit(" at Walmart and $300 elsewhere, far away from there"))
    return _events(spark, sf_dir).select("event_id", money.amount_near(text, F.lit("walmart"))["amount"].cast("double").alias("amount"))


@query("SELECT event_id, CAST(event_id % 7 AS VARCHAR) || CASE WHEN event_id % 4 = 0 THEN '' ELSE '.' || CASE event_id % 4 WHEN 1 THEN '25' WHEN 2 THEN '5' ELSE '75' END END AS number FROM events")
def plain_numbers(spark, sf_dir):
    value = (F.col("event_id") % 7 + (F.col("event_id") % 4) * F.lit(0.25).cast("decimal(4,2)")).cast("decimal(8,2)")
    return _events(spark, sf_dir).select("event_id", money.plain_number(value).alias("number"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS anchor, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS day FROM events""")
def session_days(spark, sf_dir):
    day = F.date_format("ts", "yyyy/MM/dd")
    text = F.element_at(F.array(F.concat(day, F.lit(" (Mon) 10:00")), day, F.date_format("ts", "yyyy-MM-dd"), F.lit("some day")), (F.col("event_id") % 4 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", lenient_anchor(text).alias("anchor"), session_date(text).alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 'replace' ELSE 'unknown' END AS intent FROM events")
def update_intents(spark, sf_dir):
    text = _pick("She changed the time to noon", "It was  Updated to five", "He now lives in Rome", "nothing changed", "to be changed")
    return _events(spark, sf_dir).select("event_id", graph.update_intent(text).alias("intent"))


# graph --------------------------------------------------------------------------------------------------------------


def _edges(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("string")
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("sample"), F.col("event_id").alias("seq"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("edge_id"), F.lit("user").alias("subject"),
        F.when(F.col("event_type") == "signup", "PREFERS").when(F.col("event_type") == "error", "TARGET").otherwise("ATTENDED").alias("predicate"), F.concat("event_type", F.lit(" class")).alias("object"),
        F.col("value").alias("amount"), F.lit("USD").alias("currency"), F.when(F.col("user_id") % 2 == 0, F.nullif(F.col("event_id") % 4, F.lit(0))).cast("long").alias("count"), none.alias("provider"), none.alias("location"),
        none.alias("time_value"), none.alias("time_end"), F.lit("unknown").alias("granularity"), none.alias("scope"), F.when(F.col("event_id") % 5 == 0, "superseded").alias("status"),
        none.alias("occurrence_key"), none.alias("functional_key"), F.array(F.struct(F.lit("s").alias("session"), F.col("event_id").alias("unit"))).alias("refs"),
    )


_EDGES = "e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'PREFERS' WHEN 'error' THEN 'TARGET' ELSE 'ATTENDED' END AS predicate FROM events)"


@query(f"WITH {_EDGES} SELECT user_id AS sample, event_type || ' class' AS object, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS amount FROM e GROUP BY 1, 2")
def undated_merge(spark, sf_dir):
    merged = graph.merge_edges(_edges(spark, sf_dir))
    return merged.groupBy("sample", "object").agg(F.count("*").alias("n"), F.sum(F.floor("amount").cast("long")).alias("amount"))


@query(f"WITH {_EDGES} SELECT user_id AS sample, predicate, count(*) AS n FROM e WHERE event_id % 5 <> 0 GROUP BY 1, 2")
def predicate_histogram(spark, sf_dir):
    return graph.predicate_histogram(_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT user_id AS sample, lpad(CAST(event_id AS VARCHAR), 12, '0') AS edge_id, row_number() OVER (PARTITION BY user_id ORDER BY predicate, event_type || ' class', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS place FROM e WHERE event_id % 5 <> 0")
def edge_display_order(spark, sf_dir):
    return graph.ranked_edges(graph.live_edges(_edges(spark, sf_dir))).select("sample", "edge_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_EDGES} SELECT user_id AS sample, count(*) AS edges, sum(CASE user_id % 2 WHEN 0 THEN event_id % 4 ELSE 1 END)::BIGINT AS n FROM e WHERE predicate = 'ATTENDED' AND (user_id % 2 = 1 OR event_id % 4 <> 0) GROUP BY 1")
def count_facts(spark, sf_dir):
    found = project.count_facts(_edges(spark, sf_dir), "how many of these")
    return found.groupBy("sample").agg(F.count("*").alias("edges"), F.sum("n").alias("n"))


@query(f"""WITH {_EDGES}, x AS (SELECT *, max(CASE WHEN predicate = 'ATTENDED' AND event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS meets FROM e)
SELECT user_id AS sample, lpad(CAST(event_id AS VARCHAR), 12, '0') AS edge_id FROM x WHERE CASE WHEN meets = 1 THEN event_type = 'purchase' ELSE predicate IN ('PREFERS', 'TARGET') END""")
def temporal_facts(spark, sf_dir):
    return project.temporal_facts(_edges(spark, sf_dir), "when was the purchase?").select("sample", "edge_id")


@query("""WITH r AS (SELECT user_id AS sample, CASE event_type WHEN 'view' THEN 'saw' ELSE event_type END AS relation, event_id FROM events)
SELECT sample, 'user' AS subject, relation, 'a thing' AS object, count(DISTINCT event_id % 10) AS n_refs, row_number() OVER (PARTITION BY sample ORDER BY relation) AS place FROM r GROUP BY 1, 3""")
def raw_merge(spark, sf_dir):
    relation = F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 2 == 0, " Saw ").otherwise("saw")).otherwise(F.upper("event_type"))
    ref = F.struct(F.lit("s").alias("session"), (F.col("event_id") % 10).alias("unit"))
    raw = _events(spark, sf_dir).select(F.col("user_id").alias("sample"), F.lit("User").alias("subject"), relation.alias("relation"), F.lit("A  thing").alias("object"), F.array(ref).alias("refs"))
    merged = graph.ranked_raw(graph.merge_raw(raw))
    return merged.select("sample", "subject", "relation", "object", F.size("refs").cast("long").alias("n_refs"), F.col("place").cast("long").alias("place"))


@query("""SELECT CASE event_id % 4 WHEN 0 THEN 'quarantine' WHEN 1 THEN 'raw' WHEN 2 THEN 'occurrence' ELSE 'functional' END AS way, count(*) AS n FROM events GROUP BY 1""")
def claim_ways(spark, sf_dir):
    k = F.col("event_id") % 4
    claims = _events(spark, sf_dir).select("event_id", F.when(k == 0, "incomplete").when(k == 1, "unknown_relation").otherwise("normalized").alias("parse_status"), F.when(k == 2, "USES").otherwise("PLANS").alias("predicate"))
    out = None
    for way, rows in graph.split_claims(claims).items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(way).alias("way"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_id, substr(sha256('user' || chr(1) || event_type || chr(1) || chr(0)), 1, 24) AS key FROM events")
def functional_keys(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", graph.functional_key(F.lit("user"), F.col("event_type"), F.lit(None).cast("string")).alias("key"))


# runs ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'temporal' WHEN 'view' THEN 'update' WHEN 'error' THEN 'preference' ELSE 'other' END AS rubric, count(*) AS n FROM events GROUP BY 1")
def rubrics(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "temporal-reasoning").when(F.col("event_type") == "view", "knowledge-update").when(F.col("event_type") == "error", "single-session-preference").otherwise("multi-session")
    return _events(spark, sf_dir).groupBy("event_type", manager.rubric(kind).alias("rubric")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS question_id, arm, event_type || arm AS context FROM events, (SELECT unnest(['rolling', 'memory']) AS arm) a WHERE event_id % 6 = 0")
def context_arms(spark, sf_dir):
    arm = lambda n, name: _events(spark, sf_dir).filter(F.col("event_id") % n == 0).select(F.col("event_id").alias("question_id"), F.concat("event_type", F.lit(name)).alias("context"))
    return audit.context_arms(arm(2, "rolling"), arm(3, "memory"))


@query("SELECT event_id AS question_id FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0")
def wrong_with_context(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("question_id"), F.when(F.col("event_id") % 3 == 0, "no").otherwise("yes").alias("judgment"))
    return audit.wrong_with_context(rows, rows.filter("question_id % 5 = 0"), rows.filter("question_id % 7 = 0")).select("question_id")


@query("SELECT event_id AS question_id FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 3 = 0)")
def pending_judgments(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("question_id"))
    judged = rows.select("question_id", F.when(F.col("question_id") % 2 == 0, "yes").alias("judgment"), F.when(F.col("question_id") % 3 == 0, "v2").otherwise("v1").alias("judge_version"))
    return manager.pending_judgments(rows, judged, "v2")


@query("SELECT user_id AS sample, count(*) FILTER (event_id % 2 = 0) AS kept FROM events GROUP BY 1 HAVING kept > 0")
def reusable_compactions(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("sample"), F.col("user_id"), F.col("event_type").alias("memory"))
    stored = rows.select("sample", "user_id", F.when(F.col("sample") % 2 == 0, F.sha2("memory", 256)).otherwise("old").alias("memory_hash"))
    return manager.reusable_compactions(stored, rows.select("sample", "memory")).groupBy(F.col("user_id").alias("sample")).agg(F.count("*").alias("kept"))


@query("SELECT count(DISTINCT user_id) AS samples, CAST(sum(event_id % 100) AS BIGINT) AS tokens, count(DISTINCT user_id) / 50.0::DOUBLE AS samples_per_second, sum(event_id % 100) / 50.0::DOUBLE AS tokens_per_second FROM events")
def throughput(spark, sf_dir):
    calls = _events(spark, sf_dir).select(F.col("user_id").alias("sample"), (F.col("event_id") % 100).alias("tokens"))
    return audit.throughput(calls, F.lit(50.0))


@query("""SELECT user_id AS sample, event_id, CAST(user_id % 4 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS ordinal FROM events""")
def next_ordinals(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("sample"), "event_id")
    known = rows.select("sample", (F.col("sample") % 4).alias("ordinal")).distinct()
    return store.next_ordinals(rows, known, "sample", "ordinal", "event_id").select("sample", "event_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT user_id AS sample, event_id AS item FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts) / 86400) AS BIGINT) DESC, event_id DESC) <= 3")
def last_records(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("sample"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long").alias("batch"), F.col("event_id").alias("item"))
    return route_kv.last_records(rows, 3).select("sample", "item")


@query("""SELECT user_id AS sample, 's' || CAST(max(event_id) AS VARCHAR) AS summary, max(CASE WHEN event_id % 3 = 1 THEN event_id % 17 END) FILTER (event_id = last_cut) AS last_cut, count(*) FILTER (event_id % 3 = 2) AS messages
FROM (SELECT *, max(CASE WHEN event_id % 3 = 1 THEN event_id END) OVER (PARTITION BY user_id) AS last_cut FROM events) GROUP BY 1""")
def final_state(spark, sf_dir):
    k = F.col("event_id") % 3
    last = F.max("event_id").over(stream.Window.partitionBy("user_id"))
    log = _events(spark, sf_dir).select(F.col("user_id").alias("sample"), F.col("event_id").alias("step"), F.when(k == 1, "rolling_compression").when(k == 2, "ingest").otherwise("other").alias("event"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("summary"), (F.col("event_id") % 17).alias("cut_index"), last.alias("last"))
    ends = log.filter("step = last").withColumn("event", F.lit("final"))
    return audit.final_state(log.unionByName(ends).drop("last"))


@query("SELECT user_id AS sample, event_type AS record_ref, max(event_id) AS version, max_by(CAST(floor(value) AS BIGINT), event_id) AS value FROM events GROUP BY 1, 2")
def store_view(spark, sf_dir):
    kept = store.Store(spark, fresh_path(spark, "store"))
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("sample"), F.col("event_type").alias("record_ref"), F.col("event_id").alias("version"), F.floor("value").cast("long").alias("value"))
    for part in range(3):
        kept.append("records", rows.filter(F.col("version") % 3 == part))
    return kept.view("records").select("sample", "record_ref", "version", "value")


@query("SELECT user_id AS sample, event_id AS batch, event_type FROM events WHERE event_id % 4 < 2")
def idempotent_batches(spark, sf_dir):
    kept = store.Store(spark, fresh_path(spark, "store"))
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("sample"), F.col("event_id").alias("batch"), "event_type")
    for part in (0, 1, 1, 0):
        kept.append_batch(part, batches=rows.filter(F.col("batch") % 4 == part))
    return kept.log("batches").select("sample", "batch", "event_type")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id % 9 = 0")
def json_lines_round_trip(spark, sf_dir):
    path = fresh_path(spark, "lines")
    files.write_json_lines(_events(spark, sf_dir).select("event_id", "event_type", "user_id"), path)
    rows = files.json_lines(spark, path, "event_id long, event_type string, user_id long")
    wanted = _events(spark, sf_dir).filter("event_id % 9 = 0").select("event_id")
    return files.select_strict(rows, wanted, "event_id")


@query("SELECT DISTINCT 'q' || CAST(user_id AS VARCHAR) AS question_id FROM events")
def manifest_ids(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question_id"), "event_type", "event_id")
    paths = [fresh_path(spark, "manifest") for _ in range(2)]
    files.write_manifest(rows.filter("event_id % 2 = 0"), paths[0])
    files.write_manifest(rows.filter("event_id % 2 = 1"), paths[1])
    return files.claimed_ids(spark, *paths)
