from pyspark.sql import functions as F

from palimpsest.operators import audit
from palimpsest.sources import files


def test_matching(spark):
    messages = spark.createDataFrame([(1, 0, "Hello There"), (1, 1, "costs $5"), (2, 0, "hello there")], "sample long, unit_ordinal long, content string")
    events = spark.createDataFrame([(1, 7, [1], "nothing"), (1, 8, [], "user: hello there, friend"), (2, 9, [0], "x")], "sample long, event_ordinal long, source_units array<long>, input_text string")
    got = {(r.sample, r.unit_ordinal, r.event_ordinal, r.how) for r in audit.matching_events(messages, events).collect()}
    assert got == {(1, 1, 7, "source"), (1, 0, 8, "text"), (2, 0, 9, "source")}
    assert [(r.unit_ordinal, r.matched) for r in audit.matching_messages(messages, [r"\$\d", "zzz"]).collect()] == [(1, [r"\$\d"])]


def test_samples(spark):
    row = ("q", "t", "?", "d", "a", ["s2", "s9"], ["d1", "d2"], ["s1", "s2"], [[], []])
    got = audit.answer_sessions(spark.createDataFrame([row], files.QUESTION)).orderBy("place").collect()
    assert [(r.session_id, r.session_index) for r in got] == [("s2", 1), ("s9", None)]
    states = spark.createDataFrame([(1, 0, "ingest", "", None), (1, 1, "rolling_compression", "a", 4), (1, 2, "ingest", "a", None), (1, 3, "final", "b", None)], "sample long, step long, event string, summary string, cut_index long")
    assert tuple(audit.final_state(states).first()) == (1, "b", 4, 2)


def test_arms(spark):
    a = spark.createDataFrame([("x", "r"), ("y", "r")], "question_id string, context string")
    b = spark.createDataFrame([("y", "m"), ("z", "m")], "question_id string, context string")
    assert {(r.question_id, r.arm) for r in audit.context_arms(a, b).collect()} == {("y", "rolling"), ("y", "memory")}
    judged = spark.createDataFrame([("x", "no"), ("y", "no"), ("z", "yes")], "question_id string, judgment string")
    assert [r.question_id for r in audit.wrong_with_context(judged, b).collect()] == ["x"]
    assert audit.review_rows(judged, a, b).count() == 2
    calls = spark.createDataFrame([(1, 10), (2, 30)], "sample long, tokens long")
    assert tuple(audit.throughput(calls, F.lit(4.0)).first()) == (2, 40, 0.5, 10.0)
