"""All registered queries of the engine with their DuckDB SQL. Each pair reads the driver's tables and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import money
from palimpsest.functions.text import canonical_key, canonical_text, event_coordinates, parse_judgment, predicate, short_hash, token_estimate
from palimpsest.functions.time import date_in_text, resolve_phrase, session_timestamp, time_of_text
from palimpsest.operators import chunk, evaluate, graph, project, rolling, route_kv, stream
from palimpsest.session import table

CHUNK_BUDGET, TAIL_BUDGET, BUDGETS = 64, 60, rolling.Budgets(trigger=120, prefix=48)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# conversations ------------------------------------------------------------------------------------------------------

_LINES = """lines AS (
  SELECT conv_id, turn, role, text, upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text AS line FROM conversations
), tok AS (
  SELECT *, CASE WHEN clean = '' THEN 0 ELSE len(string_split(clean, ' ')) END AS tokens
  FROM (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS clean FROM lines)
)"""
_UNITS = f"""{_LINES}, units AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS unit FROM (
    SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 0 ELSE 1 END AS fresh FROM tok)
)"""


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query(f"WITH {_UNITS} SELECT conv_id, turn, CAST(unit AS BIGINT) AS unit FROM units")
def turn_units(spark, sf_dir):
    return stream.turn_units(_talk(spark, sf_dir)).select("conv_id", "turn", "unit")


@query(f"""WITH RECURSIVE {_UNITS}, u AS (
  SELECT conv_id, unit, sum(tokens) AS tokens FROM units GROUP BY 1, 2
), f AS (
  SELECT conv_id, unit, tokens, CAST(0 AS BIGINT) AS chunk, tokens AS used FROM u WHERE unit = 0
  UNION ALL
  SELECT u.conv_id, u.unit, u.tokens, CASE WHEN f.used + u.tokens <= {CHUNK_BUDGET} THEN f.chunk ELSE f.chunk + 1 END,
         CASE WHEN f.used + u.tokens <= {CHUNK_BUDGET} THEN f.used + u.tokens ELSE u.tokens END
  FROM f JOIN u ON u.conv_id = f.conv_id AND u.unit = f.unit + 1
)
SELECT conv_id, chunk, count(*) AS units, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY 1, 2""")
def chunk_pack(spark, sf_dir):
    return chunk.chunk_pack(_talk(spark, sf_dir), CHUNK_BUDGET)


@query("""SELECT conv_id, CAST(0 AS BIGINT) AS cut FROM conversations GROUP BY 1 UNION ALL
SELECT conv_id, n FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE role = 'assistant'""")
def legal_cuts(spark, sf_dir):
    return stream.legal_cuts(_talk(spark, sf_dir))


@query(f"""WITH {_LINES} SELECT conv_id, turn, CAST(tokens AS BIGINT) AS tokens,
CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS prefix_tokens FROM tok""")
def prefix_tokens(spark, sf_dir):
    return stream.prefix_tokens(_talk(spark, sf_dir)).select("conv_id", "turn", "tokens", "prefix_tokens")


@query(f"""WITH {_LINES}, c AS (
  SELECT conv_id, turn, role, row_number() OVER w AS n, sum(tokens) OVER w AS cum FROM tok WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), t AS (SELECT conv_id, min(n) AS last, min(turn) AS "at" FROM c WHERE role = 'assistant' AND cum > {BUDGETS.trigger} GROUP BY 1),
r AS (
  SELECT c.conv_id, t."at", coalesce(min(n) FILTER (role = 'assistant' AND cum >= {BUDGETS.prefix}), max(n) FILTER (role = 'assistant' AND n < t.last)) AS cut
  FROM c JOIN t ON c.conv_id = t.conv_id AND c.n <= t.last WHERE t.last > 1 GROUP BY 1, 2
) SELECT conv_id, "at", cut FROM r WHERE cut IS NOT NULL""")
def rolling_first_cut(spark, sf_dir):
    return rolling.first_cut(_talk(spark, sf_dir), BUDGETS)


#: Message by message: n messages are in, the tail starts at message s; a cut takes the messages from s0.
_ROLLED = f"""{_LINES}, c AS (
  SELECT conv_id, list(turn ORDER BY turn) AS turns, list(role ORDER BY turn) AS roles, list(CAST(tokens AS BIGINT) ORDER BY turn) AS toks,
    list(CASE WHEN clean = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(clean, ' ') END ORDER BY turn) AS ws, count(*) AS m FROM tok GROUP BY 1
), f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(1 AS BIGINT) AS s, CAST([] AS VARCHAR[]) AS summary, CAST(NULL AS BIGINT) AS cut, CAST(1 AS BIGINT) AS s0, CAST(NULL AS VARCHAR) AS issue FROM c
  UNION ALL
  SELECT conv_id, n + 1, s + coalesce(k, 0), CASE WHEN k IS NULL THEN summary ELSE (summary || flatten(ws[s:s + k - 1]))[-20:] END, k, s, CASE WHEN full_ THEN CASE WHEN k IS NULL THEN 'no_legal_assistant_cut' END ELSE issue END
  FROM (SELECT *, CASE WHEN full_ AND n + 1 > s THEN coalesce(list_min(list_filter(range(s, n + 2), lambda j: roles[j] = 'assistant' AND list_sum(toks[s:j]) >= {BUDGETS.prefix})),
      list_max(list_filter(range(s, n + 1), lambda j: roles[j] = 'assistant'))) - s + 1 END AS k
    FROM (SELECT f.*, c.roles, c.toks, c.ws, c.roles[n + 1] = 'assistant' AND len(summary) + list_sum(c.toks[s:n + 1]) > {BUDGETS.trigger} AS full_ FROM f JOIN c ON c.conv_id = f.conv_id WHERE n < m))
)"""


@query(f"""WITH RECURSIVE {_ROLLED} SELECT c.conv_id, turns[n] AS "at", cut, turns[s0] AS first_evicted, turns[s0 + cut - 1] AS last_evicted, CAST(list_sum(toks[s0:s0 + cut - 1]) AS BIGINT) AS evicted_tokens,
len(summary) AS summary_tokens, CAST(coalesce(list_sum(toks[s:n]), 0) AS BIGINT) AS tail_tokens FROM f JOIN c ON c.conv_id = f.conv_id WHERE cut IS NOT NULL""")
def rolling_compressions(spark, sf_dir):
    return rolling.compressions(_talk(spark, sf_dir), BUDGETS)


@query(f"""WITH RECURSIVE {_ROLLED} SELECT c.conv_id, array_to_string(summary, ' ') AS summary, len(summary) AS summary_tokens, CASE WHEN s <= m THEN turns[s] END AS tail_first, m - s + 1 AS tail_messages,
CAST(len(summary) + coalesce(list_sum(toks[s:m]), 0) AS BIGINT) AS history_tokens, CASE WHEN s <= m AND roles[m] = 'user' THEN coalesce(issue, 'terminal_unpaired_user') ELSE issue END AS issue
FROM f JOIN c ON c.conv_id = f.conv_id WHERE n = m""")
def rolling_final(spark, sf_dir):
    return rolling.final_states(_talk(spark, sf_dir), BUDGETS)


@query(f"""WITH RECURSIVE {_ROLLED}, last AS (SELECT c.conv_id, unnest(turns[s:m]) AS turn FROM f JOIN c ON c.conv_id = f.conv_id WHERE n = m)
SELECT conv_id, turn, role FROM last JOIN conversations USING (conv_id, turn)""")
def rolling_tail(spark, sf_dir):
    talk = _talk(spark, sf_dir)
    return rolling.true_tails(talk, rolling.compressions(talk, BUDGETS)).select("conv_id", "turn", "role")


@query(f"""WITH {_UNITS}, b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY unit DESC) AS behind FROM units)
SELECT conv_id, turn, CAST(unit AS BIGINT) AS unit FROM b WHERE behind <= {TAIL_BUDGET}""")
def tail_by_turns(spark, sf_dir):
    return stream.tail_by_turns(_talk(spark, sf_dir), TAIL_BUDGET).select("conv_id", "turn", "unit")


@query(f"""WITH {_LINES}, t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS transcript FROM lines GROUP BY 1),
w AS (SELECT *, list_filter(regexp_split_to_array(transcript, '\\s+'), lambda x: x <> '') AS ws FROM t)
SELECT conv_id, CASE WHEN len(ws) <= {TAIL_BUDGET} THEN transcript ELSE array_to_string(ws[-{TAIL_BUDGET}:], ' ') END AS tail,
CAST(len(ws) AS BIGINT) AS full_tokens, len(ws) > {TAIL_BUDGET} AS trimmed FROM w""")
def tail_by_tokens(spark, sf_dir):
    return stream.tail_by_tokens(_talk(spark, sf_dir), TAIL_BUDGET)


@query(f"WITH {_LINES} SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS transcript FROM lines GROUP BY 1")
def render_transcript(spark, sf_dir):
    return stream.transcripts(_talk(spark, sf_dir))


@query(f"""WITH {_LINES}, p AS (SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY 1),
x AS (SELECT 'messages' AS measure, messages AS v FROM p UNION ALL SELECT 'characters', characters FROM p)
SELECT measure, min(v) AS low, list_sort(list(v))[len(list(v)) // 2 + 1] AS median, max(v) AS high FROM x GROUP BY 1""")
def profile(spark, sf_dir):
    return evaluate.profile(_talk(spark, sf_dir), "conv_id", "text")


# key/value memory over events ---------------------------------------------------------------------------------------

#: Batch is the day, item the event's number; the value is the whole part of the event's value.
_EVENTS = """ev AS (
  SELECT user_id AS sample, event_type || '.' || CAST(user_id % 3 AS VARCHAR) AS key, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS batch, event_id AS item,
         CASE WHEN event_id % 7 = 0 THEN 'NOOP' WHEN event_id % 3 = 0 THEN 'UPDATE' ELSE 'ADD' END AS action,
         CASE WHEN event_id % 11 < 9 THEN 'fact' ELSE 'event' END AS memory_type, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS value
  FROM events)"""


def _memory_events(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample"), F.concat("event_type", F.lit("."), (F.col("user_id") % 3).cast("string")).alias("key"),
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long").alias("batch"), n.alias("item"),
        F.when(n % 7 == 0, "NOOP").when(n % 3 == 0, "UPDATE").otherwise("ADD").alias("action"),
        F.when(n % 11 < 9, "fact").otherwise("event").alias("memory_type"), F.floor(F.col("value") / 10).cast("long").cast("string").alias("value"),
        F.lit("active").alias("status"),
    )


_IMMEDIATE = f"""{_EVENTS}, a AS (
  SELECT *, action <> 'NOOP' AS change, row_number() OVER (PARTITION BY sample, key, action <> 'NOOP' ORDER BY batch, item) AS k FROM ev
), b AS (SELECT *, change AND (action = 'UPDATE' OR k = 1) AS applied FROM a),
c AS (SELECT *, last_value(CASE WHEN applied THEN value END IGNORE NULLS) OVER (PARTITION BY sample, key, change ORDER BY batch, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM b),
r AS (SELECT *, CASE WHEN NOT change THEN 'noop' WHEN applied THEN 'applied' WHEN cur = value THEN 'deduplicated' ELSE 'rejected_add_conflict' END AS route_status,
      CASE WHEN applied THEN lead(item) OVER (PARTITION BY sample, key, applied ORDER BY batch, item) END AS superseded_by FROM c)"""


@query(f"WITH {_IMMEDIATE} SELECT sample, key, batch, item, route_status, superseded_by FROM r")
def kv_route_immediate(spark, sf_dir):
    r = route_kv.route_immediate(_memory_events(spark, sf_dir))
    return r.select("sample", "key", "batch", "item", "route_status", F.col("superseded_by.item").alias("superseded_by"))


@query(f"WITH {_IMMEDIATE} SELECT sample, key, value, item FROM r WHERE route_status = 'applied' AND superseded_by IS NULL")
def kv_current(spark, sf_dir):
    memory = route_kv.records(route_kv.route_immediate(_memory_events(spark, sf_dir)))
    return route_kv.active_records(memory).select("sample", "key", "value", "item")


@query(f"""WITH {_IMMEDIATE} SELECT sample, key, item FROM r WHERE superseded_by IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY sample, key ORDER BY batch DESC, item DESC) <= 2""")
def kv_ledger(spark, sf_dir):
    memory = route_kv.records(route_kv.route_immediate(_memory_events(spark, sf_dir)))
    return route_kv.update_ledger(memory).select("sample", "key", "item")


@query(f"WITH {_EVENTS} SELECT sample, key, batch, item, action <> 'NOOP' AND count(*) OVER (PARTITION BY sample, batch, key, action <> 'NOOP') > 1 AS duplicate FROM ev")
def dup_in_batch(spark, sf_dir):
    return route_kv.duplicates_in_batch(_memory_events(spark, sf_dir)).select("sample", "key", "batch", "item", "duplicate")


_BATCHED = f"""{_EVENTS}, d AS (SELECT *, action <> 'NOOP' AND count(*) OVER (PARTITION BY sample, batch, key, action <> 'NOOP') > 1 AS dup FROM ev),
x AS (SELECT *, action <> 'NOOP' AND NOT dup AS change FROM d),
y AS (SELECT *, first_value(CASE WHEN action = 'ADD' THEN memory_type END IGNORE NULLS) OVER (PARTITION BY sample, key, change ORDER BY batch, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM x),
z AS (SELECT *, change AND ((action = 'ADD' AND t IS NULL) OR (action = 'UPDATE' AND coalesce(t = memory_type, false))) AS applied FROM y),
q AS (SELECT *, last_value(CASE WHEN applied THEN value END IGNORE NULLS) OVER (PARTITION BY sample, key, change ORDER BY batch, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM z)"""


@query(f"""WITH {_BATCHED} SELECT sample, key, batch, item, CASE WHEN dup THEN 'rejected_duplicate_key_in_batch' WHEN action = 'NOOP' THEN 'noop' WHEN applied THEN 'applied'
WHEN action = 'ADD' AND cur = value THEN 'deduplicated' WHEN action = 'ADD' AND memory_type = 'event' THEN 'rejected_ambiguous_occurrence_key' WHEN action = 'ADD' THEN 'rejected_add_conflict'
WHEN t IS NULL THEN 'rejected_update_missing_target' ELSE 'rejected_update_type_mismatch' END AS route_status FROM q""")
def kv_route_batches(spark, sf_dir):
    return route_kv.route_batches(_memory_events(spark, sf_dir)).select("sample", "key", "batch", "item", "route_status")


#: The same events over three keys a type; every other update has lost a letter of its key.
_DRIFTING = """e0 AS (SELECT *, event_type || '.' || ['preference', 'location', 'next_meeting'][CAST(event_id // 3 % 3 AS INT) + 1] AS whole FROM events),
ev AS (SELECT user_id AS sample, CASE WHEN event_id % 2 = 1 AND event_id % 7 <> 0 AND event_id % 3 = 0 THEN substr(whole, 1, CAST(event_id % 11 + 1 AS BIGINT)) || substr(whole, CAST(event_id % 11 + 3 AS BIGINT)) ELSE whole END AS key,
  CAST(floor(epoch(ts) / 86400) AS BIGINT) AS batch, event_id AS item, CASE WHEN event_id % 7 = 0 THEN 'NOOP' WHEN event_id % 3 = 0 THEN 'UPDATE' ELSE 'ADD' END AS action,
  CASE WHEN event_id % 11 < 9 THEN 'fact' ELSE 'event' END AS memory_type, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS value FROM e0)"""
#: The ratio of matching blocks, block by block: the longest, the first in a and then in b of equal ones, then both sides of it.
_DRIFT = f"""WITH RECURSIVE {_BATCHED.replace(_EVENTS, _DRIFTING)},
lost AS (SELECT sample, key, batch, item FROM q WHERE NOT dup AND action = 'UPDATE' AND NOT applied AND t IS NULL),
made AS (SELECT sample, key AS candidate, min(batch) AS b0, min(item) AS i0 FROM q WHERE applied GROUP BY 1, 2),
pair AS (SELECT DISTINCT key AS a, candidate AS b FROM lost JOIN made USING (sample)),
cell AS (SELECT a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM pair)),
run AS (SELECT a, b, i, j, len(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda n: substr(a, i, n) = substr(b, j, n))) AS l FROM cell),
block AS (
  SELECT a, b, CAST(1 AS BIGINT) AS a1, CAST(length(a) AS BIGINT) AS a2, CAST(1 AS BIGINT) AS b1, CAST(length(b) AS BIGINT) AS b2, CAST(0 AS BIGINT) AS k FROM pair
  UNION ALL
  SELECT a, b, CASE WHEN side = 0 THEN a1 ELSE m.i + m.k END, CASE WHEN side = 0 THEN m.i - 1 ELSE a2 END, CASE WHEN side = 0 THEN b1 ELSE m.j + m.k END, CASE WHEN side = 0 THEN m.j - 1 ELSE b2 END, CASE WHEN side = 0 THEN m.k ELSE 0 END
  FROM (SELECT a, b, a1, a2, b1, b2, arg_max({{'i': CAST(i AS BIGINT), 'j': CAST(j AS BIGINT), 'k': CAST(n AS BIGINT)}}, n * 1000000 - i * 1000 - j) AS m
        FROM (SELECT x.*, i, j, least(l, a2 - i + 1, b2 - j + 1) AS n FROM block x JOIN run r ON r.a = x.a AND r.b = x.b AND i BETWEEN a1 AND a2 AND j BETWEEN b1 AND b2 WHERE l > 0) GROUP BY a, b, a1, a2, b1, b2), (VALUES (0), (1)) s(side)
), ratio AS (SELECT a, b, 2.0 * sum(k) / (length(a) + length(b)) AS score FROM block GROUP BY a, b)
SELECT sample, key, batch, item, arg_max(candidate, score * 1e12 - i0) AS drift_key FROM lost JOIN made USING (sample) JOIN ratio ON a = key AND b = candidate WHERE b0 < batch AND score >= 0.82 GROUP BY 1, 2, 3, 4"""


@query(_DRIFT)
def kv_key_drift(spark, sf_dir):
    n = F.col("event_id")
    word = F.element_at(F.array(*map(F.lit, ("preference", "location", "next_meeting"))), (F.floor(n / 3) % 3 + 1).cast("int"))
    whole = F.concat("event_type", F.lit("."), word)
    at = (n % 11).cast("int")
    torn = F.concat(F.substring(whole, F.lit(1), at + 1), F.substring(whole, at + 3, F.lit(100)))
    keys = table(spark, sf_dir, "events").select(n.alias("item"), F.when((n % 2 == 1) & (n % 7 != 0) & (n % 3 == 0), torn).otherwise(whole).alias("key"))
    events = _memory_events(spark, sf_dir).drop("key").join(keys, "item")
    found = route_kv.with_key_drift(route_kv.route_batches(events))
    return found.filter("drift_key is not null").select("sample", "key", "batch", "item", "drift_key")


@query(f"""WITH {_BATCHED} SELECT CASE WHEN dup THEN 'duplicate' WHEN applied THEN 'applied' ELSE 'other' END AS outcome, count(*) AS n FROM q GROUP BY 1""")
def route_histogram(spark, sf_dir):
    r = route_kv.route_batches(_memory_events(spark, sf_dir))
    name = F.when(F.col("route_status") == "rejected_duplicate_key_in_batch", "duplicate").when(F.col("route_status") == "applied", "applied").otherwise("other")
    return r.groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))


# scalar functions over text built from events -----------------------------------------------------------------------

_SAID = """said AS (SELECT event_id, ts, 'I paid $' || CAST(CAST(floor(abs(value)) AS BIGINT) AS VARCHAR) || '.50 for ' || CAST(event_id % 40 AS VARCHAR) || ' books on ' || strftime(ts, '%Y-%m-%d') AS text FROM events)"""


def _said(spark, sf_dir) -> DataFrame:
    whole = F.floor(F.abs("value")).cast("long").cast("string")
    text = F.concat(F.lit("I paid $"), whole, F.lit(".50 for "), (F.col("event_id") % 40).cast("string"), F.lit(" books on "), F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", "ts", text.alias("text"))


@query(f"""WITH {_SAID} SELECT event_id, CAST(regexp_extract(text, '\\$(\\d+\\.\\d+)', 1) AS DOUBLE) AS amount, 'USD' AS currency, event_id % 40 AS count, CAST(ts AS DATE) AS day FROM said""")
def money_count_date(spark, sf_dir):
    paid = money.amount("text")
    return _said(spark, sf_dir).select("event_id", paid["amount"].cast("double").alias("amount"), paid["currency"].alias("currency"), money.count("text").alias("count"), date_in_text("text").alias("day"))


@query("""SELECT event_id, CAST(CASE event_id % 8 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) - 1 WHEN 2 THEN date_trunc('month', CAST(ts AS DATE) - INTERVAL 1 MONTH)
WHEN 3 THEN CAST(ts AS DATE) - INTERVAL 12 MONTH WHEN 4 THEN CAST(ts AS DATE) - 21 WHEN 5 THEN CAST(ts AS DATE) - INTERVAL 2 MONTH
WHEN 6 THEN CAST(ts AS DATE) - CAST(CASE WHEN (isodow(ts) - 6 + 7) % 7 = 0 THEN 7 ELSE (isodow(ts) - 6 + 7) % 7 END AS INTEGER) ELSE NULL END AS DATE) AS day FROM events""")
def relative_time(spark, sf_dir):
    phrases = ["today", "the day before", "last month", "last year", "about 3 weeks ago", "2 months ago", "last Saturday", "some day"]
    phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", resolve_phrase(phrase, "ts").alias("day"))


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN d + 1 WHEN 1 THEN m - 14 WHEN 2 THEN m - 7 ELSE date_trunc('month', date_trunc('month', d) - INTERVAL 1 DAY) END AS DATE) AS day,
CAST(CASE event_id % 4 WHEN 1 THEN m - 8 WHEN 2 THEN m - 1 WHEN 3 THEN date_trunc('month', d) - INTERVAL 1 DAY END AS DATE) AS day_end FROM (
SELECT event_id, CAST(ts AS DATE) AS d, CAST(ts AS DATE) - CAST(isodow(ts) - 1 AS INTEGER) AS m FROM events)""")
def time_interval(spark, sf_dir):
    phrases = ["we go tomorrow", "it was the week before last", "I ran last week", "since last month"]
    text = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("event_id") % 4 + 1).cast("int"))
    when = time_of_text(text, "ts")
    return table(spark, sf_dir, "events").select("event_id", when["start"].alias("day"), when["end"].alias("day_end"))


@query("""SELECT event_id, date_trunc('minute', ts) AS "at" FROM events""")
def session_time(spark, sf_dir):
    text = F.date_format("ts", "yyyy/MM/dd '('EEE')' HH:mm")
    return table(spark, sf_dir, "events").select("event_id", session_timestamp(text).alias("at"))


@query("""SELECT event_id, 'k.' || event_type || '.a.b' AS key, CASE event_type WHEN 'purchase' THEN 'PURCHASED' END AS predicate, upper(event_type) || '!' AS loud,
substr(sha256(event_type || CAST(event_id AS VARCHAR)), 1, 24) AS hash, CAST(event_id % 9 AS BIGINT) AS batch, CAST(event_id AS BIGINT) AS item,
greatest(1, event_id // 4) AS estimate, CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS judgment FROM events""")
def canonical_forms(spark, sf_dir):
    where = event_coordinates(F.concat(F.lit("b"), (F.col("event_id") % 9).cast("string"), F.lit("-i"), F.col("event_id").cast("string")))
    answers = F.element_at(F.array(F.lit('{"judgment": "YES"}'), F.lit("I say No, not yes"), F.lit("?")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", canonical_key(F.concat(F.lit(" K_"), "event_type", F.lit("--a . b_"))).alias("key"), predicate(F.concat(F.lit("  "), "event_type")).alias("predicate"),
        F.upper(canonical_text(F.concat("event_type", F.lit(" \n!")))).alias("loud"), short_hash(F.concat("event_type", F.col("event_id").cast("string"))).alias("hash"),
        where["batch"].alias("batch"), where["item"].alias("item"), token_estimate("event_id").alias("estimate"), parse_judgment(answers).alias("judgment"),
    ).withColumn("loud", F.replace("loud", F.lit(" "), F.lit("")))


@query("""WITH t AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark UNION ALL VALUES
(-1, 'which store did i spend the most money in?'), (-2, 'how much did i pay'), (-3, 'how many days between a and b'), (-4, 'what time do i wake up'), (-5, 'how many books'))
SELECT item_id, CASE WHEN (contains(q,'store') OR contains(q,'shop') OR contains(q,'provider')) AND (contains(q,'spent') OR contains(q,'money') OR contains(q,'amount') OR contains(q,'most') OR contains(q,'least') OR contains(q,'highest') OR contains(q,'lowest')) THEN 'provider_amount_rank'
WHEN contains(q,'how much') OR contains(q,'total money') OR contains(q,'expenses') OR contains(q,'total spent') THEN 'amount_total'
WHEN contains(q,'how many days') AND contains(q,'between') THEN 'temporal'
WHEN contains(q,'what time') OR contains(q,'when do i') OR contains(q,'wake up') OR contains(q,'go to bed') OR contains(q,'how long') THEN 'temporal'
WHEN contains(q,'how many') OR contains(q,'total number') OR contains(q,'number of') THEN 'count' ELSE 'graph_all' END AS kind FROM t""")
def question_class(spark, sf_dir):
    own = [(-1, "Which store did I  spend the most money in?"), (-2, "How much did I pay"), (-3, "how many days between A and B"), (-4, "What time do I wake up"), (-5, "How many books")]
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text").union(spark.createDataFrame(own, "item_id long, text string"))
    return asked.select("item_id", project.question_class("text").alias("kind"))


# claim graph over orders and events ---------------------------------------------------------------------------------

_EDGES = """e AS (
  SELECT c_nationkey AS sample, o_orderkey AS seq, 'user' AS subject, 'PURCHASED' AS predicate, o_orderpriority AS object, o_totalprice AS amount,
         CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, o_orderkey % 5 AS count, CASE WHEN o_orderkey % 7 > 0 THEN c_mktsegment END AS provider
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _edges(spark, sf_dir) -> DataFrame:
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    text = F.lit(None).cast("string")
    return rows.select(
        F.col("c_nationkey").alias("sample"), n.alias("seq"), F.lpad(n.cast("string"), 12, "0").alias("edge_id"), F.lit("user").alias("subject"), F.lit("PURCHASED").alias("predicate"),
        F.col("o_orderpriority").alias("object"), F.col("o_totalprice").alias("amount"), F.when(n % 2 == 0, "USD").otherwise("EUR").alias("currency"), (n % 5).alias("count"),
        F.when(n % 7 > 0, F.col("c_mktsegment")).alias("provider"), text.alias("location"), text.alias("scope"), text.alias("time_value"), text.alias("occurrence_key"), F.lit("completed").alias("status"),
    )


@query(f"WITH {_EDGES} SELECT sample, predicate, coalesce(provider, '(unknown)') AS provider, currency, round(sum(amount), 2) AS total, count(*) AS edges FROM e GROUP BY 1, 2, 3, 4")
def amount_sum_by_provider(spark, sf_dir):
    sums = project.amount_sums(_edges(spark, sf_dir))
    return sums.select("sample", "predicate", "provider", "currency", F.round("total", 2).alias("total"), F.size("input_edges").cast("long").alias("edges"))


@query(f"WITH {_EDGES} SELECT sample, predicate, coalesce(provider, '(unknown)') AS provider, CAST(sum(count) AS BIGINT) AS total FROM e GROUP BY 1, 2, 3")
def count_sum_by_provider(spark, sf_dir):
    return project.count_sums(_edges(spark, sf_dir)).drop("input_edges")


@query(f"""WITH {_EDGES}, s AS (SELECT sample, provider, currency, sum(amount) AS total FROM e WHERE provider IS NOT NULL GROUP BY 1, 2, 3)
SELECT sample, CAST(row_number() OVER (PARTITION BY sample ORDER BY total DESC, provider, currency) AS INTEGER) AS rank, provider, currency, round(total, 2) AS total FROM s""")
def provider_rank(spark, sf_dir):
    return project.provider_rank(_edges(spark, sf_dir)).withColumn("total", F.round("total", 2))


@query(f"""WITH {_EDGES}, m AS (SELECT *, object LIKE '%URGENT%' AS rel, max(object LIKE '%URGENT%') OVER (PARTITION BY sample) AS any_rel FROM e)
SELECT sample, currency, round(sum(amount), 2) AS total, count(*) AS edges FROM m WHERE rel OR NOT any_rel GROUP BY 1, 2""")
def amount_total(spark, sf_dir):
    return project.amount_total(_edges(spark, sf_dir), "How much money did I spend on urgent things?").withColumn("total", F.round("total", 2))


@query(f"WITH {_EDGES} SELECT sample, count(*) FILTER (provider IS NULL) AS excluded FROM e GROUP BY 1")
def excluded_unknown(spark, sf_dir):
    return project.excluded_unknown(_edges(spark, sf_dir))


@query(f"""WITH {_EDGES}, o AS (SELECT *, CAST(regexp_matches(lower(object), 'urgent') AS INT) + CAST(provider = 'MACHINERY' AS INT) AS ov0 FROM e),
k AS (SELECT sample, seq, coalesce(ov0, CAST(regexp_matches(lower(object), 'urgent') AS INT)) AS ov FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY sample, ov > 0 ORDER BY ov DESC, seq DESC) AS rk FROM k),
a AS (SELECT *, ov > 0 AND rk <= 48 AS rel FROM r), b AS (SELECT *, count(*) FILTER (rel) OVER (PARTITION BY sample) AS n, row_number() OVER (PARTITION BY sample, rel ORDER BY seq DESC) AS rr FROM a)
SELECT sample, CASE WHEN rel THEN 'relevant' ELSE 'recent' END AS mode, CASE WHEN rel THEN rk ELSE rr END AS place, lpad(CAST(seq AS VARCHAR), 12, '0') AS edge_id FROM b WHERE rel OR rr <= 64 - n""")
def relevance_topk_fill(spark, sf_dir):
    return project.relevance_then_recency(_edges(spark, sf_dir), F.lit("an urgent machinery order of the user"))


_CLAIMS = """c AS (SELECT user_id AS sample, event_id AS seq, event_type AS object, CAST(ts AS DATE) AS day, value AS amount, 's' || CAST(user_id % 5 AS VARCHAR) AS provider, event_id AS unit FROM events)"""


def _claims(spark, sf_dir) -> DataFrame:
    text = F.lit(None).cast("string")
    day = F.struct(F.to_date("ts").alias("start"), F.lit(None).cast("date").alias("end"), F.lit("day").alias("granularity"), F.lit("ok").alias("parse_status"))
    kind = F.when(F.col("event_type") == "signup", "PREFERS").otherwise("PURCHASED")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample"), F.col("event_id").alias("seq"), F.lit("user").alias("subject"), kind.alias("predicate"), F.col("event_type").alias("object"),
        F.col("value").alias("amount"), F.lit("USD").alias("currency"), F.lit(None).cast("long").alias("count"),
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("provider"), text.alias("location"), day.alias("time"), text.alias("scope"),
        F.array(F.struct(F.col("user_id").cast("string").alias("session"), F.floor(F.col("event_id") / 50).cast("long").alias("unit"))).alias("refs"),
        F.lit("normalized").alias("parse_status"), F.lit("unknown").alias("intent"),
    )


@query(f"""WITH {_CLAIMS} SELECT sample, seq, substr(sha256(array_to_string(['user', CASE WHEN object = 'signup' THEN 'PREFERS' ELSE 'PURCHASED' END, object, CAST(day AS VARCHAR), chr(0), 'day', provider, chr(0), chr(0)], chr(1))), 1, 24) AS key FROM c""")
def occurrence_key(spark, sf_dir):
    key = graph.occurrence_key("subject", "predicate", "object", F.col("time.start"), F.col("time.end"), F.col("time.granularity"), "provider", "location", "scope")
    return _claims(spark, sf_dir).select("sample", "seq", key.alias("key"))


#: A day's claims of one user and object are a place: the first is an edge with the exact key, others of its unit join it, and of
#: the rest the first of each amount is an edge that later ones of that amount join, if they are at most 32 units away.
_ROUTED = f"""{_CLAIMS}, k AS (SELECT *, unit // 50 AS u, object = 'signup' AS fun, substr(sha256(array_to_string(['user', CASE WHEN object = 'signup' THEN 'PREFERS' ELSE 'PURCHASED' END, object, CAST(day AS VARCHAR), chr(0), 'day', provider, chr(0), chr(0)], chr(1))), 1, 24) AS key FROM c),
f AS (SELECT *, first_value(seq) OVER w AS s0, first_value(u) OVER w AS u0 FROM k WINDOW w AS (PARTITION BY sample, day, object ORDER BY seq)),
x AS (SELECT *, seq <> s0 AND u = u0 AS exact FROM f),
m AS (SELECT *, first_value(seq) OVER w AS maker, abs(u - first_value(u) OVER w) <= 32 AS near FROM x WINDOW w AS (PARTITION BY sample, day, object, exact, amount ORDER BY seq)),
t AS (SELECT *, CASE WHEN fun THEN seq WHEN exact THEN s0 WHEN near THEN maker ELSE seq END AS made FROM m),
r AS (SELECT *, made <> seq AND NOT exact AS alias, CASE WHEN fun OR seq = s0 THEN 'applied' WHEN exact OR made <> seq THEN 'joined' ELSE 'applied_ambiguous_occurrence' END AS how,
      row_number() OVER (PARTITION BY made, amount ORDER BY seq) = 1 AS new_amount, row_number() OVER (PARTITION BY made, u ORDER BY seq) = 1 AS new_unit FROM t),
q AS (SELECT *, CASE WHEN how <> 'joined' THEN '' WHEN exact AND new_amount THEN 'conflicts.amount' WHEN alias AND new_unit THEN 'refs' ELSE '' END AS merged FROM r),
e AS (SELECT sample, seq AS made, object, amount, CASE WHEN fun THEN 'active' ELSE 'completed' END AS status, CASE WHEN how = 'applied' AND NOT fun THEN key END AS occurrence_key FROM q WHERE made = seq),
i AS (SELECT *, substr(sha256(array_to_string([CAST(sample AS VARCHAR), CAST(made AS VARCHAR), coalesce(occurrence_key, 'None'), status], chr(1))), 1, 24) AS edge_id FROM e)"""


@query(f"""WITH {_ROUTED} SELECT q.sample, q.seq, CASE WHEN how <> 'joined' THEN how ELSE 'deduplicated' || CASE WHEN alias THEN '_alias' ELSE '' END || CASE WHEN merged <> '' THEN '_merged' ELSE '' END END AS route_status,
i.edge_id, CASE WHEN how = 'applied' THEN NULL WHEN how <> 'joined' THEN 'ambiguous_day' WHEN alias THEN 'provider_suffix_same_source' ELSE 'exact_key' END AS dedupe_rule, merged FROM q JOIN i ON i.made = q.made""")
def claim_routes(spark, sf_dir):
    routes = graph.route_statuses(_claims(spark, sf_dir))
    return routes.withColumn("merged", F.array_join("merged_fields", ",")).drop("merged_fields")


@query(f"""WITH {_ROUTED} SELECT i.sample, i.edge_id, i.made AS seq, i.object, i.amount, i.status, i.occurrence_key, n.n_refs FROM i JOIN (SELECT made, count(DISTINCT u) AS n_refs FROM q GROUP BY made) n ON n.made = i.made""")
def claim_edges(spark, sf_dir):
    return graph.route_edges(_claims(spark, sf_dir)).select("sample", "edge_id", "seq", "object", "amount", "status", "occurrence_key", F.size("refs").cast("long").alias("n_refs"))


#: A user's plan by scope: what a claim replaces, contradicts or repeats.
_PLANS = """c AS (SELECT user_id AS sample, event_id AS seq, 's' || CAST(user_id % 3 AS VARCHAR) || CAST(event_id % 4 AS VARCHAR) AS scope, CAST(event_id // 7 % 3 AS VARCHAR) AS object, event_type = 'purchase' AS replaces FROM events),
n AS (SELECT *, replaces AND row_number() OVER (PARTITION BY sample, scope ORDER BY seq) > 1 AS begins FROM c),
p AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY sample, scope ORDER BY seq) AS epoch, max(CAST(begins AS INT) * seq) OVER (PARTITION BY sample, scope ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > 0 AS gone FROM n),
d AS (SELECT a.sample, a.seq, bool_or(b.object <> a.object AND b.seq < a.seq) AS differs, bool_or(b.object <> a.object) AS odd FROM p a JOIN p b USING (sample, scope, epoch) GROUP BY 1, 2)"""


@query(f"""WITH {_PLANS} SELECT sample, seq, CASE WHEN begins THEN 'superseded' WHEN differs THEN 'conflict' ELSE 'applied' END AS route_status,
CASE WHEN coalesce(gone, false) THEN 'superseded' WHEN odd THEN 'contradicted' ELSE 'active' END AS status FROM p JOIN d USING (sample, seq)""")
def functional_routes(spark, sf_dir):
    n, user = F.col("seq"), F.col("sample")
    claims = _claims(spark, sf_dir).withColumns({
        "predicate": F.lit("PREFERS"), "object": F.pmod(F.floor(n / 7), F.lit(3)).cast("string"), "intent": F.when(F.col("object") == "purchase", "replace").otherwise("unknown"),
        "scope": F.concat(F.lit("s"), (user % 3).cast("string"), (n % 4).cast("string")),
    })
    return graph.routed_claims(claims).select("sample", "seq", "route_status", "status")


@query(f"""WITH {_CLAIMS} SELECT sample, object, day, min(seq) AS seq, count(DISTINCT unit // 50) AS n_refs FROM c GROUP BY 1, 2, 3""")
def edge_merge(spark, sf_dir):
    rows = _claims(spark, sf_dir)
    key = graph.occurrence_key("subject", F.lit("X"), "object", F.col("time.start"), F.col("time.end"), F.col("time.granularity"), "provider", "location", "scope")
    edges = rows.select(
        "sample", "seq", "subject", "predicate", "object", F.col("time.start").alias("day"), F.lit("completed").alias("status"), key.alias("occurrence_key"),
        F.lit(None).cast("string").alias("functional_key"), F.col("time.start").cast("string").alias("time_value"), F.lit(None).cast("string").alias("time_end"), F.lit("day").alias("granularity"), "scope", "refs",
    )
    return graph.merge_edges(edges).select("sample", "object", "day", "seq", F.size("refs").cast("long").alias("n_refs"))


@query(f"""WITH {_CLAIMS}, n AS (SELECT sample, seq, object FROM c) SELECT a.sample, CAST(a.seq AS VARCHAR) AS "left", CAST(b.seq AS VARCHAR) AS "right"
FROM n a JOIN n b ON a.sample = b.sample AND a.object = b.object AND abs(a.seq - b.seq) <= 32 AND CAST(a.seq AS VARCHAR) < CAST(b.seq AS VARCHAR)""")
def near_duplicate_range(spark, sf_dir):
    ref = F.array(F.struct(F.lit("s").alias("session"), F.col("event_id").alias("unit")))
    edges = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.lit("user").alias("subject"), F.col("event_type").alias("predicate"), F.col("event_id").cast("string").alias("edge_id"), ref.alias("refs"))
    return graph.near_matches(edges)


@query("SELECT sample, node FROM (SELECT user_id AS sample, 'user' AS node FROM events UNION SELECT user_id, event_type FROM events)")
def graph_nodes(spark, sf_dir):
    return graph.nodes(_claims(spark, sf_dir))


# evaluation ---------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, (100 * n) // sum(n) OVER () AS quota, (100 * n) % sum(n) OVER () AS rest FROM c),
k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, stratum DESC) AS k, 100 - sum(quota) OVER () AS missing FROM r)
SELECT stratum, n, CAST(quota + CASE WHEN k <= missing THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k""")
def stratified_quota(spark, sf_dir):
    return evaluate.stratified_quotas(table(spark, sf_dir, "documents"), "lang", 100)


@query("""WITH c AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, (100 * n) // sum(n) OVER () AS quota, (100 * n) % sum(n) OVER () AS rest FROM c),
k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, stratum DESC) AS k, 100 - sum(quota) OVER () AS missing FROM r), q AS (SELECT stratum, quota + CASE WHEN k <= missing THEN 1 ELSE 0 END AS quota FROM k),
p AS (SELECT doc_id, lang AS stratum, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS pk FROM documents)
SELECT doc_id, p.stratum FROM p JOIN q ON p.stratum = q.stratum WHERE pk <= quota""")
def stratified_pick(spark, sf_dir):
    return evaluate.stratified_pick(table(spark, sf_dir, "documents"), "doc_id", "lang", 100, seed=7)


_RUNS = """s AS (SELECT event_type AS run, user_id AS question, event_id AS id, event_id % 4 AS attempt, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, event_id % 13 AS calls, event_id % 997 AS latency FROM events),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run, question ORDER BY attempt DESC, id DESC) = 1)"""


def _runs(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("user_id").alias("question"), n.alias("id"), (n % 4).alias("attempt"), F.when(n % 5 == 0, "failed").otherwise("completed").alias("status"),
        (n % 13).alias("calls"), (n % 997).alias("latency"),
    )


@query(f"WITH {_RUNS} SELECT run, question, id, status FROM l")
def latest_attempt(spark, sf_dir):
    return evaluate.latest_attempts(_runs(spark, sf_dir), ["run", "question"], ["attempt", "id"]).select("run", "question", "id", "status")


@query(f"""WITH {_RUNS} SELECT run, status, count(*) AS samples, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(latency) AS BIGINT) AS latency, max(latency) AS max_latency FROM l GROUP BY GROUPING SETS ((run, status), (run))""")
def latest_attempt_stats(spark, sf_dir):
    return evaluate.run_statistics(_runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT run, list_sort(list(latency))[len(list(latency)) // 2 + 1] AS median FROM l GROUP BY 1")
def latency_median(spark, sf_dir):
    latest = evaluate.latest_attempts(_runs(spark, sf_dir), ["run", "question"], ["attempt", "id"])
    return evaluate.upper_median(latest, "latency", "run")


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def price_median(spark, sf_dir):
    return evaluate.upper_median(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")


@query("""WITH j AS (SELECT d.lang AS kind, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS y FROM labels l JOIN documents d USING (doc_id))
SELECT kind, count(*) AS total, CAST(sum(y) AS BIGINT) AS correct, round(avg(y), 9) AS accuracy FROM j GROUP BY GROUPING SETS ((kind), ())""")
def judge_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.withColumn("judgment", F.when(F.col("quality") == 1, "yes").otherwise("no"))
    return evaluate.judge_summary(rows, "lang", "judgment").withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT quality AS before, toxic AS after, count(*) AS n FROM labels GROUP BY 1, 2")
def paired_migration(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return evaluate.paired_migration(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("""SELECT item_id, doc_id, CASE WHEN contains(lower(d.text), lower(substr(b.text, 1, 120))) THEN 120 ELSE 60 END AS length
FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 1, 60)))""")
def prefix_locate(spark, sf_dir):
    return evaluate.locate_prefix(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query("""WITH need AS (SELECT DISTINCT user_id AS sample, event_id AS evidence_id, CAST(CAST(floor(abs(value)) AS BIGINT) + 0.50 AS DECIMAL(18,2)) AS amount FROM events WHERE event_type <> 'error'),
have AS (SELECT user_id AS sample, event_id AS evidence_id, CAST(CAST(floor(abs(value)) AS BIGINT) + 0.50 AS DECIMAL(18,2)) AS amount FROM events WHERE event_type = 'purchase')
SELECT n.sample, n.evidence_id, CAST(n.amount AS DOUBLE) AS amount FROM need n ANTI JOIN have h USING (sample, evidence_id, amount)""")
def evidence_unused(spark, sf_dir):
    said = _said(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "event_id")
    role = F.when(F.col("event_type") == "error", "assistant").otherwise("user")
    evidence = said.select(F.col("user_id").alias("sample"), F.col("event_id").alias("evidence_id"), role.alias("role"), "text")
    events = said.filter("event_type = 'purchase'").select(F.col("user_id").alias("sample"), F.array("event_id").alias("evidence_ids"), money.amount("text")["amount"].alias("amount"))
    return route_kv.uncovered_amounts(evidence, events, money.usd_amounts("text")).withColumn("amount", F.col("amount").cast("double"))


@query("""WITH g AS (SELECT user_id, event_id, ts, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) > 86400 AS gap FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_index FROM g""")
def sessionize(spark, sf_dir):
    return stream.sessionize(table(spark, sf_dir, "events"), "user_id", "ts", 86400).select("user_id", "event_id", "session_index")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def last_messages(spark, sf_dir):
    return rolling.tail_window(_talk(spark, sf_dir)).select("conv_id", "turn", "role")


@query("SELECT item_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ('the','and','or','to','in','of','is','a','an')))) AS useful FROM benchmark")
def useful_terms(spark, sf_dir):
    from palimpsest.constants import CONTEXT_STOP_WORDS
    from palimpsest.functions.text import terms

    stop = F.array(*[F.lit(w) for w in CONTEXT_STOP_WORDS])
    kept = F.filter(terms("text"), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(kept).cast("long").alias("useful"))


def queries() -> dict:
    _register()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(SQL)


def _register() -> None:
    """The other modules of queries add theirs to these."""
    from palimpsest.plans import catalogue_answers, catalogue_search, catalogue_state, catalogue_text  # noqa: F401
