"""Single-event and versioned answers against a plain reading of their JSON; memories as text, end to end."""

import json
import random
import re

from palimpsest.operators import answers, route_versioned

TYPES, STATUSES = ("fact", "preference", "event", "plan", "assistant_fact"), ("active", "planned", "completed")


def read_single(text, default):
    found = re.search(r"\{.*\}", text or "", re.S)
    try:
        v = json.loads(found.group(0)) if found else None
    except ValueError:
        v = None
    if not isinstance(v, dict):
        return "no_object"
    action = str(v.get("action", "")).upper()
    if action not in ("ADD", "UPDATE", "NOOP"):
        return "action"
    if action == "NOOP":
        return ("NOOP", "fact", "noop", None, "active", None, default, None)
    if v.get("memory_type") not in TYPES:
        return "memory_type"
    if not 1 <= len(str(v.get("key") or "").strip()) <= 256:
        return "key"
    if "value" not in v:
        return "value"
    if v.get("status", "active") not in STATUSES:
        return "status"
    rate = v.get("confidence")
    if rate is not None and not (isinstance(rate, int | float) and 0 <= rate <= 1):
        return "confidence"
    source = v["source"] if isinstance(v.get("source"), dict) else json.loads(default)
    return (action, v["memory_type"], v["key"].strip(), v["value"], v.get("status", "active"), v.get("event_date"), source, rate)


def test_single_events(spark):
    rng = random.Random(1)
    texts = [None, "", "no json", "[1]", '{"action": "NOOP"}', '```json\n{"action":"noop","more":1}\n```']
    for _ in range(300):
        v = {
            "action": rng.choice(["ADD", "update", "NOOP", "DROP"]), "memory_type": rng.choice([*TYPES, "other"]), "key": rng.choice(["k", " a key ", "", "x" * 257]),
            "value": rng.choice([1, "text", None, {"b": 1, "a": [2]}]), "status": rng.choice([*STATUSES, "gone"]), "event_date": rng.choice([None, "2023-05-01"]),
            "confidence": rng.choice([None, 0, 1, 0.5, 1.5]), "source": rng.choice([None, {"session_id": "s"}, "x"]),
        }
        for name in rng.sample(list(v), rng.choice([0, 0, 1, 2])):
            del v[name]
        texts.append(rng.choice(["{}", "So: {} as asked", "```json\n{}\n```"]).replace("{}", json.dumps(v)))
    default = '{"session_id":"d"}'
    df = spark.createDataFrame([("s", i, t, default, "extra") for i, t in enumerate(texts)], "sample string, batch long, answer string, source string, key string")
    rows = {r.batch: r for r in answers.single_events(df).collect()}
    seen = set()
    for i, text in enumerate(texts):
        r, want = rows[i], read_single(text, default)
        seen.add(want if isinstance(want, str) else want[0])
        if isinstance(want, str):
            assert (r.error, r.action, r.value, r.raw) == (want, None, None, text)
        elif want[0] == "NOOP":
            assert (r.action, r.memory_type, r["key"], r.value, r.status, r.event_date, r.source, r.confidence, r.error) == (*want, None)
        else:
            got = (r.action, r.memory_type, r["key"], json.loads(r.value), r.status, r.event_date, json.loads(r.source), r.confidence)
            assert r.error is None and got == want
    assert seen == {"no_object", "action", "NOOP", "memory_type", "key", "value", "status", "confidence", "ADD", "UPDATE"}


def label(x):
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    return int(x[1:]) if isinstance(x, str) and re.fullmatch(r"e[0-9]+", x) else None


def broken(v):
    if not isinstance(v, dict):
        return "item"
    op, given = str(v.get("op", "")).upper(), lambda n: v.get(n) is not None
    a, ids, expression, target = v.get("attributes", {}), v.get("evidence_ids"), v.get("time_expression"), v.get("target_ref")
    rules = [
        (op not in ("ADD", "PATCH", "REPLACE"), "unknown_op"), (v.get("record_type") not in TYPES, "unknown_record_type"),
        (not 1 <= len(str(v.get("key") or "").strip()) <= 256, "key_length"), (v.get("semantic_status") not in STATUSES, "unknown_status"), (not isinstance(a, dict), "attributes"),
        (isinstance(a, dict) and "amount" in a and (isinstance(a["amount"], bool) or not isinstance(a["amount"], int | float)), "amount"),
        (isinstance(a, dict) and "currency" in a and not (isinstance(a["currency"], str) and a["currency"].strip()), "currency"),
        (not isinstance(ids, list) or not ids, "no_evidence"), (isinstance(ids, list) and any(label(i) is None for i in ids), "evidence_form"),
        (expression is not None and not isinstance(expression, str), "time_expression"), (expression is None and given("time_evidence_id"), "time_evidence_without_time"),
        (expression is not None and label(v.get("time_evidence_id")) is None, "time_without_evidence"),
        (op == "ADD" and target is not None, "add_with_target"), (op != "ADD" and not (isinstance(target, str) and target), "no_target"),
    ]
    return next((why for bad, why in rules if bad), None)


def some_event(rng):
    op = rng.choice(["ADD", "add", "PATCH", "REPLACE"])
    v = {
        "op": op, "record_type": "fact", "key": " k ", "semantic_status": "active", "attributes": {"b": rng.choice([1, "x", None, [1]]), "a": 2.5}, "evidence_ids": [1, "e2", 1],
        "time_expression": None, "time_evidence_id": None, "target_ref": None if op.upper() == "ADD" else "r-1-0",
    }
    odd = {
        "op": ["DROP", None], "record_type": ["x", None], "key": ["", "y" * 257], "semantic_status": ["gone"], "evidence_ids": [[], None, ["2"], [True], [1.5], ["e1x"], "e1"], "target_ref": ["r-9-9", "", 5, None],
        "attributes": [[], None, {}, {"amount": "5"}, {"amount": 5}, {"amount": True}, {"amount": None}, {"currency": " "}, {"currency": "USD"}, {"currency": 1}],
        "time_expression": ["today", 5], "time_evidence_id": [1, "e2", "x", True],
    }
    for name in rng.sample(list(odd), rng.choice([0, 1, 1, 2, 3])):
        v[name] = rng.choice(odd[name])
    if rng.random() < 0.1:
        del v[rng.choice(list(v))]
    return rng.choice([v] * 30 + [7, "text", None])


def test_versioned_events(spark):
    rng = random.Random(2)
    batches = [[some_event(rng) for _ in range(rng.randint(0, 6))] for _ in range(150)]
    texts = [json.dumps({"events": b}) for b in batches] + ["nothing", None, '{"events": 5}', "{}"]
    df = spark.createDataFrame([("s", i, t, 1) for i, t in enumerate(texts)], "sample string, batch long, answer string, raw int")
    rows = {(r.batch, r.item): r for r in answers.versioned_events(df).collect()}
    assert len(rows) == sum(map(len, batches))
    reasons = set()
    for b, events in enumerate(batches):
        for i, v in enumerate(events):
            r, why = rows[b, i], broken(v)
            reasons.add(why)
            assert r.error == why, (v, r.error, why)
            if why:
                assert r.op is None and json.loads(r.raw) == v
                continue
            assert (r.op, r["key"], r.target_ref, r.time_expression) == (v["op"].upper(), v["key"].strip(), v.get("target_ref"), v.get("time_expression"))
            assert r.evidence_ids == list(dict.fromkeys(map(label, v["evidence_ids"]))) and r.time_evidence_id == label(v.get("time_evidence_id"))
            assert {k: x and json.loads(x) for k, x in r.attributes.items()} == v.get("attributes", {})
    assert len(reasons) == 16


def test_from_answers_to_memories(spark):
    event = lambda **k: {"op": "ADD", "record_type": "fact", "key": "trip", "semantic_status": "active", "attributes": {}, "evidence_ids": [1]} | k
    rows = [
        ("q1", 0, [event(attributes={"to": 'Rome "R"', "n": 2}, time_expression="yesterday", time_evidence_id="e1"), event(key="other", evidence_ids=[7]), 3]),
        ("q1", 1, [event(op="PATCH", target_ref="r-0-0", attributes={"by": None, "n": 2}), event(key="pet", attributes={"name": "Bo"}, evidence_ids=["e1", "e2"])]),
        ("q2", 0, []),
    ]
    df = spark.createDataFrame([(s, b, json.dumps({"events": e})) for s, b, e in rows], "sample string, batch long, answer string")
    evidence = spark.createDataFrame([(s, b, i, f"u{b}{i}", "2023/05/02 (Tue) 10:00") for s, b, _ in rows for i in (1, 2)], "sample string, batch long, evidence_id long, ref string, session_date string")
    events = answers.grounded(answers.versioned_events(df), evidence)
    statuses = {(r.batch, r.item): r.route_status for r in route_versioned.route_versions(events).collect()}
    assert statuses == {(0, 0): "applied", (0, 1): "rejected_invalid_evidence", (0, 2): "rejected_parse", (1, 0): "applied", (1, 1): "applied"}
    versions = route_versioned.version_records(events)
    want = [
        {"attributes": {"by": None, "n": 2, "to": 'Rome "R"'}, "date": "2023-05-01", "key": "trip", "record_ref": "r-1-0", "record_type": "fact", "semantic_status": "active"},
        {"attributes": {"name": "Bo"}, "key": "pet", "record_ref": "r-1-1", "record_type": "fact", "semantic_status": "active"},
    ]
    text = answers.versions_text(versions, with_refs=True).collect()
    assert [(r["sample"], json.loads(r.memory)) for r in text] == [("q1", {"records": want})]
    assert text[0].memory == json.dumps({"records": want}, separators=(",", ":"))
    plain = answers.versions_text(versions).collect()[0].memory
    assert json.loads(plain) == {"records": [{k: x for k, x in w.items() if k != "record_ref"} for w in want]}
