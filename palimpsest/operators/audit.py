"""Audits of runs: which stored events and states a message reached, which sessions hold an answer, run against run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.contain import containing_pairs
from palimpsest.operators.evaluate import latest_attempts, matched_patterns


def matching_messages(messages: DataFrame, patterns: list[str]) -> DataFrame:
    """Messages that match any pattern, with ``matched``, the patterns that they match."""
    return messages.withColumn("matched", matched_patterns(F.col("content"), patterns)).filter("size(matched) > 0")


def matching_events(messages: DataFrame, events: DataFrame, prefix: int = 100) -> DataFrame:
    """(sample, unit_ordinal, event_ordinal, how): events that read a message: its ordinal is among the event's sources, or
    the event's input holds the message's first characters, ignoring case.

    messages: sample, unit_ordinal, content; events: sample, event_ordinal, source_units (array), input_text. The first rule
    is an equi-join, the second a containment join by rare anchors within a sample."""
    sources = events.select("sample", "event_ordinal", F.explode("source_units").alias("unit_ordinal"))
    by_source = messages.select("sample", "unit_ordinal").join(sources, ["sample", "unit_ordinal"]).withColumn("how", F.lit("source"))
    head = F.lower(F.substring(F.trim("content"), 1, prefix))
    asked = messages.select("sample", F.col("unit_ordinal").alias("needle_id"), head.alias("needle"))
    read = events.select("sample", F.col("event_ordinal").alias("text_id"), F.lower("input_text").alias("body"))
    by_text = containing_pairs(asked, read, ["sample"])
    by_text = by_text.select("sample", F.col("needle_id").alias("unit_ordinal"), F.col("text_id").alias("event_ordinal"), F.lit("text").alias("how"))
    both = by_source.select("sample", "unit_ordinal", "event_ordinal", "how").union(by_text)
    return both.groupBy("sample", "unit_ordinal", "event_ordinal").agg(F.min("how").alias("how"))


def answer_sessions(samples: DataFrame) -> DataFrame:
    """(question_id, place, session_id, session_index): the listed answer sessions in their listed order, with the index of
    each among the sample's sessions (null where it isn't there)."""
    asked = samples.select("question_id", F.posexplode("answer_session_ids").alias("place", "session_id"))
    there = samples.select("question_id", F.posexplode("haystack_session_ids").alias("session_index", "session_id"))
    there = there.groupBy("question_id", "session_id").agg(F.min("session_index").alias("session_index"))
    return asked.join(there, ["question_id", "session_id"], "left").select("question_id", "place", "session_id", "session_index")


def final_state(states: DataFrame) -> DataFrame:
    """(sample, summary, last_cut, messages): a run's end from its state log (sample, step, event, summary, cut_index): one
    pass with conditional aggregates."""
    when = lambda event, value: F.when(F.col("event") == event, value)
    return states.groupBy("sample").agg(
        F.max_by("summary", when("final", F.col("step"))).alias("summary"), F.max_by("cut_index", when("rolling_compression", F.col("step"))).alias("last_cut"),
        F.count_if(F.col("event") == "ingest").alias("messages"),
    )


def context_arms(rolling: DataFrame, memory: DataFrame) -> DataFrame:
    """(question_id, arm, context): the same questions with either context; only questions that both arms have."""
    shared = rolling.select("question_id").intersect(memory.select("question_id"))
    arms = rolling.select("question_id", F.lit("rolling").alias("arm"), "context").unionByName(memory.select("question_id", F.lit("memory").alias("arm"), "context"))
    return arms.join(shared, "question_id", "left_semi")


def wrong_with_context(judged: DataFrame, *excluded: DataFrame) -> DataFrame:
    """Rows judged no that are in none of the excluded id sets: their context was enough, so they are asked again."""
    out = judged.filter("judgment = 'no'")
    for ids in excluded:
        out = out.join(ids.select("question_id"), "question_id", "left_anti")
    return out


def review_rows(judged: DataFrame, samples: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(question_id, payload): judgment, question and trajectory of each question as JSON, for a review page."""
    part = lambda df, name: df.select("question_id", F.struct(*[c for c in df.columns if c != "question_id"]).alias(name))
    joined = part(judged, "judged").join(part(samples, "sample"), "question_id").join(part(trajectories, "trajectory"), "question_id", "left")
    return joined.select("question_id", F.to_json(F.struct("judged", "sample", "trajectory")).alias("payload"))


def throughput(calls: DataFrame, seconds: Column) -> DataFrame:
    """(samples, tokens, samples_per_second, tokens_per_second) of finished calls (sample, tokens)."""
    n, t = F.count_distinct("sample"), F.sum("tokens")
    return calls.agg(n.alias("samples"), t.alias("tokens"), (n / F.max(seconds)).alias("samples_per_second"), (t / F.max(seconds)).alias("tokens_per_second"))


def latest_completed(samples: DataFrame) -> DataFrame:
    """The last completed attempt of each (run, question)."""
    return latest_attempts(samples.filter("status = 'completed'"), ["run", "question"], ["attempt", "id"])
