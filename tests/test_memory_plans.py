import json

from pyspark.sql import functions as F

from palimpsest.operators import manager
from palimpsest.operators.stream import Stream
from palimpsest.plans import memory


def messages(spark):
    rows = [(1, 0, "user", "I bought red shoes for $40 at Acme on 2023/05/02"), (1, 1, "assistant", "nice"), (1, 2, "user", "I live in Rome"), (1, 3, "assistant", "ok")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_claim_graph(spark):
    claim = {"subject_text": "user", "relation": "bought", "object_text": "red shoes", "evidence_ids": [0], "hints": {"provider_text": "Acme"}}
    answers = spark.createDataFrame([(1, 0, json.dumps({"claims": [claim, claim]}))], "sample long, batch long, answer string")
    out = memory.claim_graph(messages(spark), memory.recorded(answers), budget=500)
    assert sorted(r.route_status for r in out["routes"].collect()) == ["applied", "deduplicated"]
    edge = out["merged"].first()
    assert (edge.amount, edge.provider, edge.time_value) == (40.0, "acme", "2023-05-02")
    texts = spark.createDataFrame([(1, "new shoes")], "sample long, text string")
    view = json.loads(manager.graph_context(out["merged"], texts).first().context)
    assert view["active_edge_count"] == 1 and view["relevant_edges"][0]["object"] == "red shoes" and view["recent_edges"] == [] and not view["truncated"]


def test_key_value(spark):
    event = '{"events": [{"action": "ADD", "memory_type": "fact", "key": "home", "value": "Rome", "status": "active", "source": {"evidence_ids": [2]}}]}'
    out = memory.key_value_memory(messages(spark), memory.computed(F.lit(event)))
    assert [(r.key, r.value, r.status) for r in out["records"].collect()] == [("home", '"Rome"', "active")]
    made = manager.compactor_input(out["records"]).first()
    assert made.event_ids == ["b0-i0"]


def test_splits(spark):
    cited = memory.evidence(messages(spark), 500, Stream())
    units = cited.select("sample", "batch", "evidence_id", F.floor(F.col("evidence_id") / 2).alias("turn"))
    cut = F.when(F.col("chunk_text").contains("shoes") & F.col("chunk_text").contains("Rome"), '{"events": [1').otherwise('{"events": []}')
    got = {(r.batch, r.part): r.status for r in memory.extract_with_splits(cited, units, memory.computed(cut)).collect()}
    assert got == {(0, "00"): "ok", (0, "01"): "ok"}
    never = memory.extract_with_splits(cited, units, memory.computed(F.lit('{"a": [')))
    assert {r.status for r in never.collect()} == {"manager_output_unfit"}


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(manager.summary_of(F.lit('{"summary_text": "s"}'))) == "s"
    assert one(manager.summary_of(F.lit('{"summary_text": "s", "b": 1}'))) is None
    assert tuple(one(manager.answer_and_evidence(F.lit("plain")))) == ("plain", None)
    assert tuple(one(manager.answer_and_evidence(F.lit('{"answer": "a", "evidence": "e"}')))) == ("a", "e")
    assert one(F.to_json(manager.json_or(F.lit("{bad"), "[]"))) == "[]"
    groups = spark.createDataFrame([(1, '{"duplicate_groups": [{"record_refs": ["a", "b", "a"]}, {"x": 1}]}')], "sample long, answer string")
    assert [(r.record_refs, r.error is None) for r in manager.duplicate_groups(groups).orderBy("ordinal").collect()] == [(["a", "b"], True), (None, False)]
    judged = spark.createDataFrame([("a", "yes", "v1"), ("b", None, "v1"), ("c", "no", "v0")], "question_id string, judgment string, judge_version string")
    rows = spark.createDataFrame([(x,) for x in "abcd"], "question_id string")
    assert sorted(r.question_id for r in manager.pending_judgments(rows, judged, "v1").collect()) == ["b", "c", "d"]
