"""Question files with string ids through streams, rolling states, and routing."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, parse, rolling, stream
from palimpsest.plans import memory

SCHEMA = "question_id string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"


def sample(question, sessions=1, messages=12, words=20):
    talk = [[("user" if m % 2 == 0 else "assistant", " ".join(f"s{s}m{m}w{w}" for w in range(words))) for m in range(messages)] for s in range(sessions)]
    return (question, [f"2023/05/{s + 1:02d} (Mon) 10:00" for s in range(sessions)], [f"id{s}" for s in range(sessions)], talk)


def test_rolling_over_question_rows(spark):
    rows = stream.messages_of_samples(spark.createDataFrame([sample("q_a"), sample("q_b", 3, 4)], SCHEMA))
    budgets = rolling.Budgets(trigger=200, prefix=80)
    done = [r for r in rolling.compressions(rows, budgets, s=stream.SAMPLES).collect() if r.question_id == "q_a"]
    assert [(r["at"], r.cut, r.first_evicted, r.last_evicted) for r in done] == [(9, 4, 0, 3)]
    # four messages of 21 words, and the header of the session before them, of six
    assert done[0].evicted_tokens == 4 * 21 + 7 and done[0].tail_tokens == 6 * 21 + 7
    final = {r.question_id: r for r in rolling.final_states(rows, budgets, s=stream.SAMPLES).collect()}
    assert (final["q_a"].tail_first, final["q_a"].tail_messages) == (4, 8)
    tail = rolling.true_tails(rows, rolling.compressions(rows, budgets, s=stream.SAMPLES), s=stream.SAMPLES).filter("question_id = 'q_a'")
    assert sorted(r.unit_ordinal for r in tail.collect()) == [*range(4, 12)]


def test_claims_of_string_samples_to_merged_edges(spark):
    rows = stream.messages_of_samples(spark.createDataFrame([sample("q_a", 1, 4)], SCHEMA)).withColumn("date", F.to_date(F.lit("2023-05-01")))
    said = '{"claims": [{"subject_text": "user", "relation": "visited", "object_text": "the zoo", "evidence_ids": [1]}, {"subject_text": "user", "relation": "visited", "object_text": "the park", "evidence_ids": ["1"]}]}'
    asked = []

    def extractor(chunks):
        asked.append(1)
        return chunks.select("sample", "batch", F.lit(said).alias("answer"))

    made = memory.claim_graph(rows, extractor, s=stream.SAMPLES)
    status = {r.object: r.parse_status for r in made["claims"].collect()}
    assert status["the park"] == "incomplete" and len(asked) == 1
    assert {r.sample for r in made["routes"].collect()} == {"q_a"}
    assert made["merged"].count() == made["edges"].count()


def test_undated_occurrences_stay_apart(spark):
    edges = spark.createDataFrame(
        [("a", i, f"e{i}", "user", "ATTENDED", "a class", float(10 * i), None, None, None, None, None, None, None, [("s", i)]) for i in (1, 2, 3)],
        "sample string, seq long, edge_id string, subject string, predicate string, object string, amount double, occurrence_key string, functional_key string, time_value string, "
        "time_end string, granularity string, scope string, status string, refs array<struct<session:string,unit:long>>",
    )
    merged = graph.merge_edges(edges)
    assert sorted(r.amount for r in merged.collect()) == [10.0, 20.0, 30.0]


@pytest.mark.parametrize(
    ("answer", "cut"),
    [
        ('{"a": [1, 2', True), ('{"a": "x', True), ('{"a": 1}', False), ("", False), ("no json", False), ("```json\n{\"a\": {\n```", True),
        ('{"a": "}"', True), ('{"a": "\\\\"}', False), ('{"a": "\\"}', True), ("[1, 2]", False), ('{"a": }', False), (None, None),
    ],
)
def test_truncation(spark, answer, cut):
    assert spark.createDataFrame([(answer,)], "x string").select(parse.is_truncated("x").alias("t")).first().t is cut
