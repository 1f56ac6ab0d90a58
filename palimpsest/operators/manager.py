"""What an extractor, an answerer or a judge gets to see, and what is read from their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import evidence_label, json_object
from palimpsest.operators.project import relevance_then_recency


def labelled_chunks(messages: DataFrame) -> DataFrame:
    """(sample, batch, chunk_text): messages (sample, batch, evidence_id, date, role, content) as labelled lines, with a
    date line wherever the date changes."""
    w = Window.partitionBy("sample", "batch").orderBy("evidence_id")
    new_date = ~F.lag("date").over(w).eqNullSafe(F.col("date"))
    line = evidence_label("evidence_id", "role", "content")
    headed = F.when(new_date & F.col("date").isNotNull(), F.concat(F.lit("## "), F.col("date").cast("string"), F.lit("\n"), line)).otherwise(line)
    rows = messages.withColumn("line", headed)
    lists = rows.groupBy("sample", "batch").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "line"))).alias("x"))
    return lists.select("sample", "batch", F.array_join(F.transform("x", lambda m: m["line"]), "\n").alias("chunk_text"))


def graph_context(edges: DataFrame, texts: DataFrame, max_edges: int = 64) -> DataFrame:
    """(sample, context): a bounded JSON view of each sample's live edges: those that share words with the sample's text, then
    the newest, with counts and flags of what was left out."""
    joined = edges.join(texts.select("sample", F.col("text").alias("_text")), "sample", "left")
    chosen = relevance_then_recency(joined, F.coalesce("_text", F.lit("")), max_edges)
    shape = F.struct(
        "subject", "predicate", "object", "status",
        F.struct("amount", "currency", "count", "provider", "location").alias("attributes"), F.col("time_value").alias("time"), "scope",
    )
    shown = chosen.join(edges.select("sample", "edge_id", shape.alias("edge")), ["sample", "edge_id"])
    part = lambda mode: F.transform(F.filter("xs", lambda x: x["mode"] == mode), lambda x: x["edge"])
    lists = shown.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("mode", "place", "edge"))).alias("xs"), F.count("*").alias("shown"))
    totals = edges.groupBy("sample").agg(F.count("*").alias("active"))
    out = lists.join(totals, "sample")
    view = F.struct(
        F.col("active").alias("active_edge_count"), part("recent").alias("recent_edges"), part("relevant").alias("relevant_edges"),
        (F.col("shown") < F.col("active")).alias("truncated"),
    )
    return out.select("sample", F.to_json(view).alias("context"))


def compactor_input(memory: DataFrame) -> DataFrame:
    """(sample, records, event_ids): active records as JSON with their ids, for one summary per sample."""
    row = F.struct("batch", "item", "key", "memory_type", "status", "value")
    lists = memory.groupBy("sample").agg(F.array_sort(F.collect_list(row)).alias("rs"))
    ids = F.transform("rs", lambda r: F.concat(F.lit("b"), r["batch"].cast("string"), F.lit("-i"), r["item"].cast("string")))
    return lists.select("sample", F.to_json("rs").alias("records"), ids.alias("event_ids"))


def summary_of(answer: Column) -> Column:
    """The text of a compactor's answer, an object with just ``summary_text``; else null."""
    v = json_object(answer, lenient=False)
    only = F.json_object_keys(F.to_json(v))
    text = F.try_variant_get(v, "$.summary_text", "string")
    return F.when((F.size(only) == 1) & (F.trim(text) != ""), text)


def duplicate_groups(answers: DataFrame) -> DataFrame:
    """(sample, ordinal, record_refs, error): groups of a reconciler's answer; refs without repeats; a bad group keeps its
    place with an error."""
    v = answers.select("sample", json_object("answer").alias("v"))
    groups = v.select("sample", F.posexplode(F.try_variant_get("v", "$.duplicate_groups", "array<variant>")).alias("ordinal", "g"))
    refs = F.try_variant_get("g", "$.record_refs", "array<string>")
    good = refs.isNotNull() & F.forall(refs, lambda r: r.isNotNull() & (r != ""))
    return groups.select(
        "sample", F.col("ordinal").cast("long").alias("ordinal"), F.when(good, F.array_distinct(refs)).alias("record_refs"),
        F.when(~F.coalesce(good, F.lit(False)), "record_refs must be non-empty strings").alias("error"),
    )


def answer_and_evidence(answer: Column) -> Column:
    """struct(answer, evidence): from JSON, else the whole text without evidence."""
    v = json_object(answer)
    said = F.try_variant_get(v, "$.answer", "string")
    return F.struct(F.coalesce(said, F.trim(answer)).alias("answer"), F.when(said.isNotNull(), F.try_variant_get(v, "$.evidence", "string")).alias("evidence"))


def json_or(text: Column, default: str) -> Column:
    """Parsed JSON, or the default's where it is none."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit(default)))


def pending_judgments(rows: DataFrame, judged: DataFrame, version: str) -> DataFrame:
    """Rows (question_id, ...) without a judgment by this judge's version."""
    done = judged.filter(F.col("judgment").isNotNull() & (F.col("judge_version") == version))
    return rows.join(done.select("question_id"), "question_id", "left_anti")


def rubric(kind: Column) -> Column:
    """Which rubric judges a question of a kind: three have their own."""
    return F.when(kind == "temporal-reasoning", "temporal").when(kind == "knowledge-update", "update").when(kind == "single-session-preference", "preference").otherwise("other")


def reusable_compactions(compactions: DataFrame, memory: DataFrame) -> DataFrame:
    """Stored compactions (sample, memory_hash, ...) whose sample's memory (sample, memory) is still the same."""
    now = memory.select("sample", F.sha2("memory", 256).alias("memory_hash"))
    return compactions.join(now, ["sample", "memory_hash"], "left_semi")
