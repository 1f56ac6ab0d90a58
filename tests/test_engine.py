"""Closed forms against folds, literals, batch against stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import money, text, time
from palimpsest.operators import chunk, evaluate, graph, parse, project, rolling, route_kv, route_versioned, stream
from palimpsest.sources import files
from palimpsest.sources.store import Store, next_ordinals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# scalar functions


@pytest.mark.parametrize(
    ("phrase", "day"),
    [("last Saturday", "2023-04-29"), ("yesterday", "2023-05-04"), ("about 2 weeks ago", "2023-04-21"), ("last month", "2023-04-01"), ("March 3rd", "2023-03-03"),
     ("3 months ago", "2023-02-05"), ("February 30, 2020", None), ("2020-02-29", "2020-02-29"), ("soon", None), ("last year", "2022-05-05")],
)
def test_phrases(spark, phrase, day):
    found = one(spark, time.resolve_phrase(F.lit(phrase), F.lit("2023-05-05").cast("date")))
    assert found == (datetime.date.fromisoformat(day) if day else None)


@pytest.mark.parametrize(
    ("said", "start", "end"),
    [("since last month", "2023-04-01", "2023-04-30"), ("it was last week", "2023-05-08", "2023-05-14"), ("the week before last", "2023-05-01", "2023-05-07"),
     ("last Saturday", "2023-05-13", None), ("on May 2, 2021 I", "2021-05-02", None), ("at 2021/3/4", "2021-03-04", None), ("never", None, None)],
)
def test_times(spark, said, start, end):
    found = one(spark, time.time_of_text(F.lit(said), F.lit("2023-05-15").cast("date")))
    assert [found.start and str(found.start), found.end and str(found.end)] == [start, end]
    assert found.parse_status == ("ok" if start else "unparsed")


def test_money_and_counts(spark):
    assert str(one(spark, money.amount(F.lit("cost € 1,234.5 or $2"))["amount"])) == "1234.50"
    assert one(spark, money.amount(F.lit("cost € 1,234.5"))["currency"]) == "EUR"
    assert [str(x) for x in one(spark, money.usd_amounts(F.lit("$1,000.00 and $1000 and €5")))] == ["1000.00", "1000.00"]
    assert one(spark, money.count(F.lit("read 12 good books in 7-10 days"))) == 12
    assert one(spark, money.count(F.lit("7-10 days"))) is None
    said = "the house may cost $300,000 in the end and Acme Bank gave $250,000"
    assert str(one(spark, money.amount_near(F.lit(said), F.lit("acme bank"))["amount"])) == "250000.00"
    assert one(spark, money.plain_number(F.lit("1.50").cast("decimal(18,2)"))) == "1.5"


def test_text(spark):
    assert one(spark, text.canonical_text(F.lit("  Ａ \n b "), unicode_forms=True)) == "a b"
    assert one(spark, text.canonical_key(F.lit(" Home__City - now. "))) == "home.city.now"
    assert one(spark, text.predicate(F.lit("Is  attending"))) == "ATTENDED"
    assert one(spark, text.predicate(F.lit("dislikes"))) is None
    assert set(one(spark, text.query_terms(F.lit("How many grocery stores and berries did I visit")))) == {"grocery", "store", "berry", "visit"}
    assert one(spark, text.json_object(F.lit('```json\n{"a": 1}\n```'), lenient=False).isNotNull())
    assert one(spark, text.json_object(F.lit('see {"a": 1} there'), lenient=False).isNull())
    assert one(spark, F.to_json(text.json_object(F.lit('see {"a": 1} there')))) == '{"a":1}'
    assert one(spark, text.event_coordinates(F.lit("b3-i14")))["item"] == 14
    assert one(spark, text.rendered(F.lit("user"), F.lit("hi"))) == "User: hi"
    cut = spark.createDataFrame([('{"a": [1, 2',), ('{"a": 1}',), ('{"a" 1}',), ("",)], "t string")
    assert [r.x for r in cut.select(parse.is_truncated("t").alias("x")).collect()] == [True, False, False, False]


# streams


def talk(spark, seed=1, samples=12, system=True):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "assistant", "user", "assistant", "system" if system else "user"]), " ".join("w" * rnd.randint(1, 30))) for c in range(samples) for t in range(rnd.randint(1, 30))]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def greedy_units(roles):
    out, i, unit = [], 0, 0
    while i < len(roles):
        pair = roles[i] == "user" and i + 1 < len(roles) and roles[i + 1] == "assistant"
        out += [unit] * (2 if pair else 1)
        i += 2 if pair else 1
        unit += 1
    return out


def test_units_and_chunks(spark):
    rows, df = talk(spark)
    units = {(r.conv_id, r.turn): r.unit for r in stream.turn_units(df).collect()}
    chunks = {(r.conv_id, r.turn): r.chunk for r in chunk.chunk_messages(df, 40).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        expected = greedy_units([r[2] for r in own])
        assert [units[c, r[1]] for r in own] == expected
        n, used, last = -1, 0, None
        for r, u in zip(own, expected, strict=True):
            if u != last:
                size = sum(len(x[3].split()) + 1 for x, y in zip(own, expected, strict=True) if y == u)
                if n < 0 or used + size > 40:
                    n, used = n + 1, 0
                used, last = used + size, u
            assert chunks[c, r[1]] == n


def test_rolling_literal(spark):
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", " ".join(["w"] * 19)) for i in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = rolling.compressions(df, rolling.Budgets(200, 80)).collect()
    assert [(r.at, r.cut, r.first_evicted, r.last_evicted) for r in done] == [(11, 4, 0, 3)]
    assert [r.turn for r in rolling.true_tails(df, rolling.compressions(df, rolling.Budgets(200, 80))).orderBy("turn").collect()] == list(range(4, 12))
    end = rolling.final_states(df, rolling.Budgets(200, 80)).first()
    assert (end.tail_first, end.tail_messages, end.summary_tokens, end.issue) == (4, 8, 20, None)


def test_first_cut_is_the_folds_first(spark):
    _, df = talk(spark, 3, 20)
    budgets = rolling.Budgets(90, 40)
    folded = {}
    for r in rolling.compressions(df, budgets).orderBy("at").collect():
        folded.setdefault(r.conv_id, (r.at, r.cut))
    assert {r.conv_id: (r.at, r.cut) for r in rolling.first_cut(df, budgets).collect()} == folded


def test_first_cut_counts_the_headers_of_dated_sessions(spark):
    rnd = random.Random(9)
    rows = []
    for q in range(25):
        session = 0
        for k in range(rnd.randint(1, 24)):
            session += rnd.random() < 0.3
            rows.append((f"q{q}", k, session, f"2023/05/{session + 1:02} (Mon) 10:00", "user" if k % 2 == 0 else "assistant", " ".join(["w"] * rnd.randint(0, 9))))
    df = spark.createDataFrame(rows, "question_id string, unit_ordinal long, session_index long, session_date string, role string, content string")
    budgets, folded = rolling.Budgets(70, 30), {}
    for r in rolling.compressions(df, budgets, s=stream.SAMPLES).orderBy("at").collect():
        folded.setdefault(r.question_id, (r.at, r.cut))
    assert {r.question_id: (r.at, r.cut) for r in rolling.first_cut(df, budgets, stream.SAMPLES).collect()} == folded
    assert len(folded) > 5


def test_stream_gives_what_batch_gives(spark, tmp_path):
    from palimpsest.streaming.rolling import stream_compressions

    rows, df = talk(spark, 5)
    for k in range(3):  # three files are three micro-batches, each later in the turns
        df.filter(F.floor(F.col("turn") / 10) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_compressions(source, rolling.Budgets(60, 24)).writeStream.format("memory").queryName("rolled").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rolling.replay_identical(spark.table("rolled"), rolling.compressions(df, rolling.Budgets(60, 24)))


def test_tails(spark):
    rows, df = talk(spark, 7, 4)
    by_turns = {}
    for r in stream.tail_by_turns(df, 50).collect():
        by_turns.setdefault(r.conv_id, []).append(r.turn)
    for c in range(4):
        own = [r for r in rows if r[0] == c]
        units = greedy_units([r[2] for r in own])
        kept, used = [], 0
        for u in sorted(set(units), reverse=True):
            part = [r for r, x in zip(own, units, strict=True) if x == u]
            used += sum(len(r[3].split()) + 1 for r in part)
            if used > 50:
                break
            kept += [r[1] for r in part]
        assert sorted(by_turns.get(c, [])) == sorted(kept)


def test_questions_to_messages(spark):
    rows = [("q", "t", "?", "d", "gold", ["b"], ["2023/05/02 (Tue) 10:00", "2023/05/01 (Mon) 09:00"], ["b", "a"], [[("user", "later", True)], [("user", "first", False), ("assistant", None, None)]])]
    df = spark.createDataFrame(rows, files.QUESTION)
    got = stream.with_headers(stream.messages_of_samples(files.without_gold(df))).orderBy("unit_ordinal").collect()
    assert [(r.session_id, r.content, r.opens_session) for r in got] == [("a", "first", True), ("a", "", False), ("b", "later", True)]
    assert got[0].raw_text == "## Session 1 — 2023/05/01 (Mon) 09:00\nUser: first"
    assert "answer" not in files.without_gold(df).columns


# key/value routing


def fold_immediate(events):
    memory, out = {}, []
    for e in events:
        live = memory.get(e["key"])
        if e["action"] == "NOOP":
            out.append("noop")
        elif e["action"] == "ADD" and live is not None:
            out.append("deduplicated" if live == e["value"] else "rejected_add_conflict")
        else:
            memory[e["key"]] = e["value"]
            out.append("applied")
    return out


def fold_batches(events):
    memory, out = {}, []
    for b in sorted({e["batch"] for e in events}):
        part, before = [e for e in events if e["batch"] == b], dict(memory)
        keys = [e["key"] for e in part if e["action"] != "NOOP"]
        for e in part:
            live = before.get(e["key"])
            if e["action"] == "NOOP":
                out.append("noop")
            elif keys.count(e["key"]) > 1:
                out.append("rejected_duplicate_key_in_batch")
            elif e["action"] == "ADD" and live:
                same = live[0] == e["value"]
                out.append("deduplicated" if same else "rejected_ambiguous_occurrence_key" if e["memory_type"] == "event" else "rejected_add_conflict")
            elif e["action"] == "UPDATE" and not live:
                out.append("rejected_update_missing_target")
            elif e["action"] == "UPDATE" and live[1] != e["memory_type"]:
                out.append("rejected_update_type_mismatch")
            else:
                memory[e["key"]] = (e["value"], e["memory_type"])
                out.append("applied")
    return out


def kv_events(seed):
    rnd = random.Random(seed)
    return [
        {"sample": s, "batch": i // 3, "item": i % 3, "key": rnd.choice("abc"), "action": rnd.choice(["ADD", "ADD", "UPDATE", "NOOP"]), "memory_type": rnd.choice(["fact", "event"]), "value": rnd.choice(["1", "2"]), "status": "active"}
        for s in range(60)
        for i in range(rnd.randint(1, 24))
    ]


@pytest.mark.parametrize(("route", "fold"), [(route_kv.route_immediate, fold_immediate), (route_kv.route_batches, fold_batches)])
def test_routing_closed_forms(spark, route, fold):
    events = kv_events(11)
    got = {(r.sample, r.batch, r.item): r.route_status for r in route(spark.createDataFrame(events)).collect()}
    for s in range(60):
        own = [e for e in events if e["sample"] == s]
        assert [got[s, e["batch"], e["item"]] for e in own] == fold(own)


def test_ledger_drift_and_memory(spark):
    rows = [(1, 0, 0, "user.home.city", "ADD", "fact", '"A"', "active"), (1, 1, 0, "user.home.citi", "UPDATE", "fact", '"B"', "active"), (1, 2, 0, "user.home.city", "UPDATE", "fact", '"C"', "active"), (1, 3, 0, "zzz", "UPDATE", "fact", '"D"', "active")]
    events = spark.createDataFrame(rows, "sample long, batch long, item long, key string, action string, memory_type string, value string, status string")
    routed = route_kv.with_key_drift(route_kv.route_batches(events))
    assert {r.batch: (r.route_status, r.drift_key) for r in routed.collect()} == {0: ("applied", None), 1: ("rejected_key_drift", "user.home.city"), 2: ("applied", None), 3: ("rejected_update_missing_target", None)}
    memory = route_kv.records(routed)
    assert [r.value for r in route_kv.update_ledger(memory).collect()] == ['"A"']
    assert [r.value for r in route_kv.active_records(memory).collect()] == ['"C"']
    assert "superseded" in route_kv.answer_memory(memory, with_superseded=True).first().memory


def test_stream_routing(spark, tmp_path):
    from palimpsest.streaming.route import route_into

    events = spark.createDataFrame(kv_events(13))
    store, take = Store(spark, str(tmp_path)), None
    take = route_into(store)
    for b in range(8):
        take(events.filter(F.col("batch") == b), b)
    take(events.filter("batch = 7"), 7)  # a retried batch changes nothing
    cols = ["sample", "key", "batch", "item", "route_status"]
    got = store.log("routes").select(*cols)
    assert rolling.replay_identical(got, route_kv.route_batches(events).select(*cols))


def test_parse_memory_events(spark):
    answer = '{"events": [{"action": "add", "memory_type": "fact", "key": "Home City", "value": 3, "status": "active", "source": {"evidence_ids": [0]}}, {"action": "NOOP"}, {"action": "NOOP", "key": "x"}, 5, {"action": "ADD", "memory_type": "fact", "key": "k", "value": null, "status": "active", "source": {"evidence_ids": [9]}}, {"action": "ADD", "memory_type": "odd", "key": "k", "value": 1, "status": "active"}]}'
    answers = spark.createDataFrame([(1, 0, answer), (1, 1, "no json")], "sample long, batch long, answer string")
    evidence = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "sample long, batch long, evidence_id long")
    got = parse.memory_events(answers, evidence).orderBy("item").collect()
    assert [(r.action, r.key, r.reject) for r in got] == [("ADD", "home.city", None), ("NOOP", None, None), ("NOOP", "x", "rejected_parse"), (None, None, "rejected_parse"), ("ADD", "k", "rejected_parse" if got[4].value is None else "rejected_invalid_evidence"), ("ADD", "k", "rejected_parse")]


# claims


def claim_rows(spark, rows):
    full = []
    for k, r in enumerate(rows):
        base = {"sample": 1, "seq": k, "subject": "user", "predicate": "PURCHASED", "object": "shoes", "amount": None, "currency": None, "count": None, "provider": None, "location": None,
                "time": (None, None, "unknown", "unparsed"), "scope": None, "refs": [("s1", k)], "intent": "unknown", "parse_status": "normalized"}
        full.append(tuple((base | r).values()))
    schema = "sample long, seq long, subject string, predicate string, object string, amount double, currency string, count long, provider string, location string, time struct<start:date,end:date,granularity:string,parse_status:string>, scope string, refs array<struct<session:string,unit:long>>, intent string, parse_status string"
    return spark.createDataFrame(full, schema)


DAY = (datetime.date(2023, 5, 1), None, "day", "ok")
MONTH = (datetime.date(2023, 5, 1), datetime.date(2023, 5, 31), "month", "ok")


def statuses(spark, rows):
    return [r.route_status for r in graph.route_statuses(claim_rows(spark, rows)).orderBy("seq").collect()]


def test_occurrences(spark):
    assert statuses(spark, [{}, {}]) == ["applied_ambiguous_occurrence"] * 2
    assert statuses(spark, [{"time": MONTH}, {"time": MONTH, "amount": 5.0}]) == ["applied", "deduplicated_merged"]
    assert statuses(spark, [{"time": DAY}, {"time": DAY}, {"time": DAY, "refs": [("s1", 0)]}]) == ["applied", "applied_ambiguous_occurrence", "deduplicated"]
    alias = {"time": DAY, "provider": "acme", "amount": 9.0, "currency": "USD"}
    assert statuses(spark, [alias | {"object": "shoes"}, alias | {"object": "shoes from acme"}]) == ["applied", "deduplicated_alias_merged"]
    assert statuses(spark, [alias, alias | {"object": "shoes from acme", "refs": [("s1", 99)]}]) == ["applied", "applied"]
    assert statuses(spark, [{"parse_status": "incomplete"}, {"parse_status": "unknown_relation"}]) == ["quarantined", "raw_unknown_relation"]
    edge = graph.route_edges(claim_rows(spark, [{"time": MONTH, "amount": 4.0}, {"time": MONTH, "amount": 5.0, "provider": None}])).first()
    assert edge.amount == 4.0 and edge.conflicts == {"amount": ["4.0", "5.0"]} and len(edge.refs) == 2


def test_functional(spark):
    home = {"predicate": "LOCATED_IN", "object": "rome", "scope": "home"}
    assert statuses(spark, [home, home | {"object": "oslo"}]) == ["applied", "conflict"]
    assert statuses(spark, [home, home | {"object": "oslo", "intent": "replace"}]) == ["applied", "superseded"]
    assert statuses(spark, [home | {"scope": None}, home | {"scope": None, "object": "oslo"}]) == ["applied", "applied"]
    edges = graph.route_edges(claim_rows(spark, [home, home | {"object": "oslo", "intent": "replace"}]))
    assert [r.object for r in graph.live_edges(edges).collect()] == ["oslo"]
    merged = graph.merge_edges(graph.route_edges(claim_rows(spark, [home, home, home | {"object": "oslo"}]))).orderBy("object").collect()
    assert [(r.object, r.status, len(r.refs)) for r in merged] == [("oslo", "contradicted", 1), ("rome", "contradicted", 2)]


def test_claims_end_to_end(spark):
    answer = '{"claims": [{"subject_text": "User", "relation": "bought", "object_text": "organic chicken", "evidence_ids": [0], "hints": {"provider_text": "Thrive Market", "amount_text": "$150"}}, {"subject_text": "User", "relation": "bought", "object_text": "milk", "evidence_ids": [0], "hints": {"provider_text": "Walmart", "location_text": "Mars"}}, {"subject_text": "User", "relation": "hums", "object_text": "songs", "evidence_ids": [0]}, {"subject_text": "", "relation": "bought", "object_text": "x", "evidence_ids": [0]}, {"subject_text": "User", "relation": "bought", "object_text": "x", "evidence_ids": [1]}]}'
    said = "I spent $150 on organic chicken at Thrive Market yesterday. Milk was $120 at Walmart."
    answers = spark.createDataFrame([(1, 0, answer)], "sample long, batch long, answer string")
    evidence = spark.createDataFrame([(1, 0, 0, "user", said, "s1", 4, datetime.date(2023, 5, 15)), (1, 0, 1, "assistant", "ok", "s1", 5, datetime.date(2023, 5, 15))], "sample long, batch long, evidence_id long, role string, content string, session string, unit long, date date")
    got = parse.claims(answers, evidence)
    rows = got.orderBy("seq").collect()
    assert [r.parse_status for r in rows] == ["normalized", "normalized", "unknown_relation", "incomplete", "incomplete"]
    assert [float(r.amount) for r in rows[:2]] == [150.0, 120.0] and rows[1].dropped == ["location_text"] and str(rows[0].time.start) == "2023-05-14"
    edges = graph.merge_edges(graph.live_edges(graph.route_edges(got)))
    ranked = project.provider_rank(edges, "At which store did I spend the most money on groceries?").collect()
    assert [(r.rank, r.provider, r.total) for r in ranked] == [(1, "thrive market", 150.0)]  # only chicken is a grocery here
    ranked = project.provider_rank(edges, "At which store did I spend the most money?").collect()
    assert [(r.rank, r.provider, r.total) for r in ranked] == [(1, "thrive market", 150.0), (2, "walmart", 120.0)]
    assert project.amount_total(edges).first().total == 270.0
    shown = project.graph_lines(edges).first()
    assert shown.edges == 2 and shown.nodes == 3 and "provider=walmart" in shown.context


def test_counts_and_times(spark):
    edges = graph.merge_edges(graph.route_edges(claim_rows(spark, [
        {"predicate": "COMPLETED", "object": "8 online courses"}, {"predicate": "COMPLETED", "object": "courses on art", "count": 12}, {"predicate": "USES", "object": "tea"},
        {"predicate": "OBSERVED_WAKE_TIME", "object": "woke at 7", "time": DAY}, {"sample": 2, "predicate": "ATTENDED", "object": "graduation of ann"}, {"sample": 2, "predicate": "USES", "object": "cup"},
    ])))
    counted = project.count_facts(edges, "How many courses did I complete?").groupBy("sample", "mode").agg(F.sum("n").alias("n")).collect()
    assert {(r.sample, r.mode, r.n) for r in counted} == {(1, "numeric", 20), (2, "occurrence_fallback", 2)}
    one_left = project.count_facts(edges, "How many graduations did I attend?").filter("sample = 2").collect()
    assert [r.n for r in one_left] == [1]
    assert [r.object for r in project.temporal_facts(edges, "What time do I wake up?").collect()] == ["woke at 7"]


# versioned records


def version_events(spark, rows):
    full = []
    for k, r in enumerate(rows):
        base = {"sample": 1, "batch": k, "item": 0, "op": "ADD", "record_type": "fact", "key": "k", "semantic_status": "active", "attributes": {}, "has_time": False, "time_ok": True, "date": None, "evidence_ok": True, "refs": [f"e{k}"], "target_ref": None, "error": None}
        full.append(tuple((base | r).values()))
    return spark.createDataFrame(full, "sample long, batch long, item long, op string, record_type string, key string, semantic_status string, attributes map<string,string>, has_time boolean, time_ok boolean, date string, evidence_ok boolean, refs array<string>, target_ref string, error string")


def routes(spark, rows):
    return [r.route_status for r in route_versioned.route_versions(version_events(spark, rows)).orderBy("batch", "item").collect()]


def test_versions(spark):
    dated = {"has_time": True, "date": "2023-05-01"}
    assert routes(spark, [{"attributes": {"a": "1"}}, {"attributes": {"a": "1"}}]) == ["applied", "applied"]
    assert routes(spark, [dated | {"attributes": {"a": "1"}}] * 2) == ["applied", "deduplicated_source_merged"]
    assert routes(spark, [dated | {"attributes": {"a": "1"}}, dated | {"attributes": {"b": "2"}}]) == ["applied", "converted_add_to_patch"]
    assert routes(spark, [dated | {"attributes": {"a": "1"}}, dated | {"attributes": {"a": "2"}}]) == ["applied", "rejected_add_conflict"]
    patch = {"op": "PATCH", "target_ref": "r-0-0"}
    assert routes(spark, [{"attributes": {"a": "1"}}, patch | {"attributes": {"b": "2"}}, patch]) == ["applied", "applied", "rejected_invalid_target"]
    assert routes(spark, [{"attributes": {"a": "1"}}, patch | {"attributes": {"a": "2"}}, patch | {"key": "z"}]) == ["applied", "rejected_patch_conflict", "rejected_target_mismatch"]
    assert routes(spark, [dated, patch | {"has_time": True, "date": "2023-05-02"}]) == ["applied", "rejected_patch_temporal_conflict"]
    assert routes(spark, [{}, patch | {"batch": 1}, patch | {"batch": 1, "item": 1}]) == ["applied", "rejected_duplicate_target_in_batch", "rejected_duplicate_target_in_batch"]
    assert routes(spark, [{"error": "x"}, {"has_time": True, "time_ok": False}, {"evidence_ok": False}]) == ["rejected_parse", "rejected_invalid_time_evidence", "rejected_invalid_evidence"]


def test_reconcile(spark):
    events = version_events(spark, [{"attributes": {"a": "1"}}, {"attributes": {"b": "2"}}, {"attributes": {"a": "3"}}])
    groups = spark.createDataFrame([(1, 0, ["r-0-0", "r-1-0"]), (1, 1, ["r-0-0", "r-2-0"])], "sample long, ordinal long, record_refs array<string>")
    versions = route_versioned.version_records(events, groups)
    now = {r.record_ref: (r.attributes, sorted(r.refs)) for r in route_versioned.current_records(versions).collect()}
    assert now == {"r-final-0": ({"a": "1", "b": "2"}, ["e0", "e1"]), "r-2-0": ({"a": "3"}, ["e2"])}


def test_repairs(spark):
    schema = "sample long, batch long, item long, op string, record_type string, key string, semantic_status string, attributes map<string,string>, evidence_ids array<long>, time_expression string, time_evidence_id long, target_ref string"
    events = spark.createDataFrame([(1, 0, 0, "ADD", "fact", "k", "active", {"a": "1"}, [0], None, None, None)], schema)
    repairs = spark.createDataFrame([(1, 0, 0, "ADD", "fact", "k", "active", {"amount": "5"}, [1], None, None, None), (1, 0, 1, "ADD", "fact", "z", "active", {"amount": "6"}, [2], None, None, None)], schema)
    got = {r.key: (r.attributes, r.evidence_ids) for r in route_versioned.merge_repairs(events, repairs).collect()}
    assert got == {"k": ({"a": "1", "amount": "5"}, [0, 1]), "z": ({"amount": "6"}, [2])}
    checked = route_versioned.validated(repairs.withColumn("target_ref", F.when(F.col("key") == "z", "r-1-1"))).collect()
    assert {r.key: r.error for r in checked} == {"k": None, "z": "add_with_target"}


# evaluation, store


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "abcd"[min(3, i % 7)]) for i in range(300)], "id long, kind string")
    picked = evaluate.stratified_pick(rows, "id", "kind", 12, 1)
    assert picked.count() == 12
    assert rolling.replay_identical(picked, evaluate.stratified_pick(rows.repartition(7), "id", "kind", 12, 1))
    rest = evaluate.stratified_pick(rows.join(picked, "id", "left_anti"), "id", "kind", 12, 1)
    assert rest.count() == 12 and rest.join(picked, "id").count() == 0


def test_locate_prefix(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega end"
    needles = spark.createDataFrame([(1, long), (2, "one two three"), (3, "tiny"), (4, None)], "n long, text string")
    texts = spark.createDataFrame([(1, "x" + long.upper() + "y"), (2, long[:70]), (3, "none two three, tiny"), (4, None), (5, "aone two threeb")], "t long, text string")
    got = {(r.n, r.t, r.length) for r in evaluate.locate_prefix(needles, texts, "n", "t").collect()}
    assert got == {(1, 1, 120), (1, 2, 60), (2, 3, 120), (2, 5, 120), (3, 3, 120)}


def test_diagnostics(spark):
    rows = [("q", 0, 2, 1, False), ("q", 0, 2, 2, True), ("q", 1, 1, 5, True), ("q", 1, 1, 6, True)]
    got = evaluate.evidence_diagnostics(spark.createDataFrame(rows, "question_id string, session_index long, date_rank long, message_index long, has_answer boolean")).first()
    assert tuple(got)[1:] == (2, 3, 1, 1, 1, 0, 1)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "run string, question string, attempt long, id long, status string, fingerprint string, hypothesis string"
    store.append("samples", spark.createDataFrame([("r", "a", 1, 1, "failed", "f", None), ("r", "b", 1, 2, "completed", "f", "B")], schema))
    store.append("samples", spark.createDataFrame([("r", "a", 2, 3, "completed", "f", "A"), ("r", "c", 1, 4, "not_runnable", "f", None)], schema))
    assert {(r.question, r.status) for r in store.view("samples").collect()} == {("a", "completed"), ("b", "completed"), ("c", "not_runnable")}
    wanted = spark.createDataFrame([("r", q) for q in "abcd"], "run string, question string")
    assert [r.question for r in store.pending(wanted, "f").collect()] == ["d"]
    assert store.pending(wanted, "other").count() == 4
    assert {tuple(r) for r in store.hypotheses("r").collect()} == {("a", "A"), ("b", "B")}
    store.append("batches", spark.createDataFrame([(1, 0, 0, "h")], "sample long, batch long, version long, input_hash string"))
    with pytest.raises(ValueError):
        store.check_batches(spark.createDataFrame([(1, 0, "other")], "sample long, batch long, input_hash string"))
    more = next_ordinals(spark.createDataFrame([("r", "z")], "run string, q string"), spark.createDataFrame([("r", 4)], "run string, n long"), "run", "n", "q")
    assert more.first().n == 5


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "question_id string, x string")
    files.write_manifest(rows, str(tmp_path / "m"))
    assert {r.question_id for r in files.claimed_ids(spark, str(tmp_path / "m")).collect()} == {"a", "b"}
    files.write_json_lines(rows, str(tmp_path / "j"))
    assert files.json_lines(spark, str(tmp_path / "j"), "question_id string, x string").count() == 2
    with pytest.raises(ValueError):
        files.select_strict(rows, spark.createDataFrame([("c",)], "question_id string"), "question_id")
    assert "<td>1</td>" in files.html_report(rows, "t", 5) and "## b" in files.markdown_audit(rows, "question_id", 5)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
