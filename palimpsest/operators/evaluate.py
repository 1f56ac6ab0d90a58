"""Statistics, sampling, judging, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.contain import containing_pairs
from palimpsest.operators.select import nth_values, smallest


def latest_attempts(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, from one aggregate rather than a sort."""
    rest = [c for c in samples.columns if c not in keys]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def upper_median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, median): the element at n // 2 of the sorted values, selected by histograms, so no group is sorted."""
    found = nth_values(rows, value, list(keys), lambda g: g.withColumn("k", F.floor(F.col("n") / 2)))
    return found.select(*keys, F.col("value").alias("median"))


def run_statistics(samples: DataFrame) -> DataFrame:
    """(run, status, samples, calls, latency) of the latest attempt per question, for each status and (status null) all."""
    latest = latest_attempts(samples, ["run", "question"], ["attempt", "id"])
    return latest.rollup("run", "status").agg(F.count("*").alias("samples"), F.sum("calls").alias("calls"), F.sum("latency").alias("latency"), F.max("latency").alias("max_latency")).filter("run is not null")


def judge_summary(judged: DataFrame, kind: str, judgment: str) -> DataFrame:
    """(kind, total, correct, accuracy): by kind and overall (kind null); only yes and no count."""
    rows = judged.filter(F.col(judgment).isin("yes", "no")).select(F.col(kind).alias("kind"), (F.col(judgment) == "yes").cast("long").alias("y"))
    return rows.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("total"), F.sum("y").alias("correct"), F.avg("y").alias("accuracy"))


def paired_migration(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(before, after, n): how answers moved between two runs."""
    a, b = left.select(key, F.col(value).alias("before")), right.select(key, F.col(value).alias("after"))
    return a.join(b, key).groupBy("before", "after").agg(F.count("*").alias("n"))


def stratified_quotas(rows: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, n, quota): exact largest-remainder quotas; ties of the remainder go to the later name.

    The strata are a handful of rows; integers keep the remainders exact."""
    counts = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    rated = counts.withColumn("quota", F.floor(F.lit(size) * F.col("n") / total).cast("long")).withColumn("rest", F.pmod(F.lit(size) * F.col("n"), total))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), F.desc("stratum"))
    left = F.lit(size) - F.sum("quota").over(everything)
    return rated.withColumn("k", F.row_number().over(order)).select("stratum", "n", (F.col("quota") + F.when(F.col("k") <= left, 1).otherwise(0)).cast("long").alias("quota"))


def stratified_pick(rows: DataFrame, key: str, stratum: str, size: int, seed: int = 0) -> DataFrame:
    """(key, stratum): exactly ``size`` rows by the quotas (all, if there are fewer), the same ones for the same seed whatever
    the partitioning; null is a stratum. No stratum is sorted: the pick is a selection by rank."""
    return smallest(rows, key, stratum, seed, stratified_quotas(rows, stratum, size))


def profile(messages: DataFrame, key: str, text: str) -> DataFrame:
    """(measure, low, median, high) of messages, characters and estimated tokens per stream."""
    per = messages.groupBy(key).agg(F.count("*").alias("messages"), F.sum(F.char_length(text)).alias("characters"))
    wide = per.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("messages", "characters")])).alias("x")).select("x.*")
    ends = wide.groupBy("measure").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.join(upper_median(wide, "v", "measure"), "measure").select("measure", "low", "median", "high")


def evidence_diagnostics(messages: DataFrame) -> DataFrame:
    """Per question, from rows (question_id, session_index original, date_rank, message_index from 1, has_answer): how many
    sessions and messages hold evidence, where the first is, and the round of each session's first."""
    hits = messages.filter("has_answer")
    per = hits.groupBy("question_id", "session_index", "date_rank").agg(F.min("message_index").alias("first"), F.count("*").alias("n"))
    turn = F.floor((F.col("first") + 1) / 2)
    return per.groupBy("question_id").agg(
        F.count("*").alias("evidence_sessions"), F.sum("n").alias("evidence_messages"), (F.min("session_index") + 1).alias("first_original"), F.min("date_rank").alias("first_chronological"),
        F.count_if(turn == 1).alias("round_1"), F.count_if(turn == 2).alias("round_2"), F.count_if(turn >= 3).alias("round_3_plus"),
    )


def locate_prefix(needles: DataFrame, texts: DataFrame, needle_id: str, text_id: str, lengths: tuple[int, int] = (120, 60)) -> DataFrame:
    """(needle_id, text_id, length): texts that hold the first 120 characters of a needle, ignoring case, or else its first
    60, found by a containment join of the latter. Null and empty needles are in no text; ids are unique."""
    heads = [F.lower(F.substring(F.col("text"), 1, n)) for n in lengths]
    asked = needles.select(F.col(needle_id).alias("needle_id"), heads[1].alias("needle"))
    held = texts.select(F.col(text_id).alias("text_id"), F.lower("text").alias("body"))
    found = containing_pairs(asked, held, [])
    long = needles.select(F.col(needle_id).alias("needle_id"), heads[0].alias("long"))
    length = F.when(F.contains("body", F.col("long")), lengths[0]).otherwise(lengths[1])
    return found.join(long, "needle_id").select(F.col("needle_id").alias(needle_id), F.col("text_id").alias(text_id), length.alias("length"))


def matched_patterns(text: Column, patterns: list[str]) -> Column:
    """The patterns of a list that a text matches."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(p)) for p in patterns]))


def history_stats(samples: DataFrame) -> DataFrame:
    """(question_id, sessions, messages, characters, answer_sessions) of each question row with its nested sessions."""
    flat = F.flatten(F.transform("haystack_sessions", lambda s: F.transform(s, lambda m: F.char_length(F.coalesce(m["content"], F.lit(""))))))
    return samples.select(
        "question_id", F.size("haystack_sessions").cast("long").alias("sessions"), F.size(flat).cast("long").alias("messages"),
        F.aggregate(flat, F.lit(0).cast("long"), lambda a, b: a + b).alias("characters"), F.size("answer_session_ids").cast("long").alias("answer_sessions"),
    )
