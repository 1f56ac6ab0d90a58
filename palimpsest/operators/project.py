"""Answers from merged edges: question classes, aggregates, rankings, counts, temporal facts, bounded context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.constants import CATEGORY_HINTS, CONTEXT_STOP_WORDS, NUMERIC_PREDICATES, OCCURRENCE_PREDICATES
from palimpsest.functions import money
from palimpsest.functions.text import canonical_text, query_terms, singular, terms
from palimpsest.operators.graph import edge_order

UNKNOWN_PROVIDER = "(unknown)"


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def question_class(question: Column | str) -> Column:
    """provider_amount_rank, amount_total, temporal, count or graph_all; substring rules, the first that fits."""
    q = canonical_text(question)
    return (
        F.when(_has(q, "store", "shop", "provider") & _has(q, "spent", "money", "amount", "most", "least", "highest", "lowest"), "provider_amount_rank")
        .when(_has(q, "how much", "total money", "expenses", "total spent"), "amount_total")
        .when(q.contains("how many days") & q.contains("between"), "temporal")
        .when(_has(q, "what time", "when do i", "wake up", "go to bed", "how long"), "temporal")
        .when(_has(q, "how many", "total number", "number of"), "count")
        .otherwise("graph_all")
    )


def edge_terms() -> Column:
    """Terms of an edge that a question can meet: object, provider, location, scope, plural ends dropped."""
    text = F.concat_ws(" ", "object", "provider", "location", "scope")
    return F.array_distinct(F.transform(terms(text), singular))


def _relevant_or_all(edges: DataFrame, relevant: Column) -> DataFrame:
    """Of each sample's edges the relevant ones, or all if none is."""
    any_here = F.max(relevant.cast("int")).over(Window.partitionBy("sample"))
    return edges.withColumn("_any", any_here).withColumn("_rel", relevant).filter("_any = 0 or _rel").drop("_any", "_rel")


def _asked(question: str) -> Column:
    words = query_terms(F.lit(question))
    hints = [F.when(F.array_contains(words, c), F.array(*[F.lit(h) for h in hs])).otherwise(F.array().cast("array<string>")) for c, hs in CATEGORY_HINTS.items()]
    return F.concat(words, *hints)


def _ids() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(edge_order())], F.col("edge_id").alias("id"))))
    return F.transform(ordered, lambda x: x["id"])


def amount_sums(edges: DataFrame, predicates=NUMERIC_PREDICATES) -> DataFrame:
    """(sample, predicate, provider, currency, total, input_edges) over merged edges with an amount."""
    rows = edges.filter(F.col("predicate").isin(*predicates) & F.col("amount").isNotNull())
    return rows.groupBy("sample", "predicate", F.coalesce("provider", F.lit(UNKNOWN_PROVIDER)).alias("provider"), "currency").agg(F.sum("amount").alias("total"), _ids().alias("input_edges"))


def count_sums(edges: DataFrame, predicates=NUMERIC_PREDICATES) -> DataFrame:
    """(sample, predicate, provider, total, input_edges) over merged edges with a count."""
    rows = edges.filter(F.col("predicate").isin(*predicates) & F.col("count").isNotNull())
    return rows.groupBy("sample", "predicate", F.coalesce("provider", F.lit(UNKNOWN_PROVIDER)).alias("provider")).agg(F.sum("count").alias("total"), _ids().alias("input_edges"))


def provider_rank(edges: DataFrame, question: str = "") -> DataFrame:
    """(sample, rank, provider, currency, total): purchases with a known provider, those that meet the question if any do,
    ranked by total and then by name."""
    rows = edges.filter("predicate = 'PURCHASED' and amount is not null and provider is not null and provider <> ''")
    rows = _relevant_or_all(rows, F.arrays_overlap(edge_terms(), _asked(question)))
    sums = rows.groupBy("sample", "provider", "currency").agg(F.sum("amount").alias("total"))
    order = Window.partitionBy("sample").orderBy(F.desc("total"), "provider", "currency")
    return sums.withColumn("rank", F.row_number().over(order)).select("sample", "rank", "provider", "currency", "total")


def excluded_unknown(edges: DataFrame) -> DataFrame:
    """(sample, excluded): purchases with an amount but no provider."""
    return edges.groupBy("sample").agg(F.count_if(F.expr("predicate = 'PURCHASED' and amount is not null and coalesce(provider, '') = ''")).alias("excluded"))


def amount_total(edges: DataFrame, question: str = "", mix_currencies: bool = False) -> DataFrame:
    """(sample, currency, total, edges): purchased amounts, those that meet the question if any do. One row a currency;
    ``mix_currencies`` adds them all up, which earlier systems did."""
    rows = _relevant_or_all(edges.filter("predicate = 'PURCHASED' and amount is not null"), F.arrays_overlap(edge_terms(), query_terms(F.lit(question))))
    currency = F.lit(None).cast("string") if mix_currencies else F.col("currency")
    return rows.groupBy("sample", currency.alias("currency")).agg(F.sum("amount").alias("total"), F.count("*").alias("edges"))


def temporal_facts(edges: DataFrame, question: str) -> DataFrame:
    """Targets, preferences and observations, or the attended and observed facts that meet the question if any do; for
    questions on waking and bed only facts about these."""
    meets = F.arrays_overlap(edge_terms(), query_terms(F.lit(question))) & F.col("predicate").isin("ATTENDED", "OBSERVED")
    any_here = F.max(meets.cast("int")).over(Window.partitionBy("sample"))
    usual = F.col("predicate").isin("TARGET", "PREFERS", "OBSERVED", "OBSERVED_WAKE_TIME")
    rows = edges.withColumn("_any", any_here).filter(F.when(F.col("_any") == 1, meets).otherwise(usual)).drop("_any")
    clean = " ".join(question.lower().split())
    if "wake" in clean or "bed" in clean:
        rows = rows.filter((F.col("predicate") == "OBSERVED_WAKE_TIME") | _has(F.col("object"), "wake", "woke", "waking", "bed"))
    return rows


def count_facts(edges: DataFrame, question: str) -> DataFrame:
    """(sample, mode, edge_id, n): edges with a count (their own or one in the object's words); in samples without any,
    the occurrences that meet the question, or all occurrences, one each."""
    n = F.coalesce("count", money.count("object"))
    typed = edges.filter(F.col("predicate").isin(*NUMERIC_PREDICATES)).withColumn("n", n).filter("n is not null")
    if "course" in question.lower():
        typed = typed.filter(F.col("object").contains("course"))
    typed = typed.select("sample", F.lit("numeric").alias("mode"), "edge_id", "n")
    rest = edges.filter(F.col("predicate").isin(*OCCURRENCE_PREDICATES)).join(typed.select("sample").distinct(), "sample", "left_anti")
    rest = _relevant_or_all(rest, F.arrays_overlap(terms("object"), query_terms(F.lit(question))))
    return typed.unionByName(rest.select("sample", F.lit("occurrence_fallback").alias("mode"), "edge_id", F.lit(1).cast("long").alias("n")))


def graph_lines(edges: DataFrame) -> DataFrame:
    """(sample, context, edges, nodes): merged edges as text in display order, and how many edges and nodes there are."""
    detail = F.concat_ws(
        "; ",
        F.when(F.col("amount").isNotNull(), F.trim(F.concat(F.lit("amount="), F.col("amount").cast("string"), F.lit(" "), F.coalesce("currency", F.lit(""))))),
        F.when(F.col("count").isNotNull(), F.concat(F.lit("count="), F.col("count").cast("string"))),
        F.concat(F.lit("provider="), "provider"),
        F.concat(F.lit("location="), "location"),
        F.concat(F.lit("time="), "time_value", F.coalesce(F.concat(F.lit(".."), "time_end"), F.lit(""))),
        F.concat(F.lit("scope="), "scope"),
        F.when(F.col("status") == "contradicted", "status=contradicted"),
        F.concat(F.lit("sources="), F.array_join(F.transform("refs", lambda r: F.concat(F.lit("u"), r["unit"].cast("string"))), ",")),
    )
    line = F.concat(F.lit("- "), "subject", F.lit(" --"), "predicate", F.lit("--> "), "object", F.lit("; "), detail)
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(edge_order())], line.alias("line"))
    out = edges.groupBy("sample").agg(
        F.array_sort(F.collect_list(keyed)).alias("ls"), F.count("*").alias("edges"), F.size(F.array_distinct(F.concat(F.collect_set("subject"), F.collect_set("object")))).alias("nodes")
    )
    return out.select("sample", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("context"), "edges", F.col("nodes").cast("long").alias("nodes"))


def relevance_then_recency(edges: DataFrame, text: Column | str, max_edges: int = 64, relevant_max: int = 48) -> DataFrame:
    """(sample, mode, place, edge_id): up to ``relevant_max`` edges that share terms with the sample's ``text`` column, by
    overlap, keyed ones first, newest first; the rest of the budget with the newest others."""
    stop = F.array(*[F.lit(w) for w in CONTEXT_STOP_WORDS])

    def useful(words: Column) -> Column:
        return F.filter(words, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))

    about = useful(terms(F.concat_ws(" ", "object", "provider", "location")))
    asked = F.filter(useful(terms(text)), lambda t: t != "user")
    rows = edges.withColumn("overlap", F.size(F.array_intersect(about, asked)))
    best = Window.partitionBy("sample", F.col("overlap") > 0).orderBy(F.desc("overlap"), F.col("occurrence_key").isNull(), F.desc("seq"), "edge_id")
    taken = rows.withColumn("k", F.row_number().over(best)).withColumn("relevant", (F.col("overlap") > 0) & (F.col("k") <= min(relevant_max, max_edges)))
    per_sample = Window.partitionBy("sample")
    newest = Window.partitionBy("sample", "relevant").orderBy(F.desc("seq"), "edge_id")
    taken = taken.withColumn("n", F.count_if("relevant").over(per_sample)).withColumn("r", F.row_number().over(newest))
    chosen = taken.filter(F.col("relevant") | (F.col("r") <= F.lit(max_edges) - F.col("n")))
    mode = F.when(F.col("relevant"), "relevant").otherwise("recent")
    return chosen.select("sample", mode.alias("mode"), F.when(F.col("relevant"), F.col("k")).otherwise(F.col("r")).cast("long").alias("place"), "edge_id")
