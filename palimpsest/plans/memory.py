"""End-to-end plans: messages to chunks, an extractor's answers, parsed rows, routed memory, answers.

The extractor is any function from chunks (sample, batch, chunk_text) to answers (sample, batch, answer). The core needs
no model: recorded answers replay a run, a column expression stands in for one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import chunk, graph, manager, parse, route_kv
from palimpsest.operators.stream import Stream
from palimpsest.session import written

Extractor = Callable[[DataFrame], DataFrame]


def recorded(answers: DataFrame) -> Extractor:
    """Stored answers (sample, batch, answer) for the chunks they belong to."""
    return lambda chunks: chunks.select("sample", "batch").join(answers.select("sample", "batch", "answer"), ["sample", "batch"])


def computed(answer: Column) -> Extractor:
    """Answers that a column expression gives from ``chunk_text``."""
    return lambda chunks: chunks.select("sample", "batch", answer.alias("answer"))


def evidence(messages: DataFrame, budget: int, s: Stream) -> DataFrame:
    """(sample, batch, evidence_id, unit, role, content, session, date) of messages packed into chunks."""
    session = F.col(s.session).cast("string") if s.session else F.lit("0")
    date = F.to_date("date") if "date" in messages.columns else F.lit(None).cast("date")
    placed = chunk.chunk_messages(messages, budget, s)
    return placed.select(
        F.col(s.key).alias("sample"), F.col("chunk").alias("batch"), "evidence_id", F.col(s.order).cast("long").alias("unit"), F.col(s.role).alias("role"),
        F.col(s.text).alias("content"), session.alias("session"), date.alias("date"),
    )


def claim_graph(messages: DataFrame, extractor: Extractor, budget: int = 2048, s: Stream | None = None) -> dict[str, DataFrame]:
    """claims, routes, edges and merged (live edges, one row each) of message streams. The extractor is asked once and claims
    are routed once: answers, routed claims and edges are written before anything reads them."""
    cited = evidence(messages, budget, s or Stream())
    answers = written(extractor(manager.labelled_chunks(cited)), "answers")
    claims = parse.claims(answers, cited)
    routed = graph.routed_claims(claims)
    edges = written(graph.edges_of(routed), "edges")
    return {"claims": claims, "routes": graph.statuses_of(routed), "edges": edges, "merged": graph.merge_edges(graph.live_edges(edges))}


def key_value_memory(messages: DataFrame, extractor: Extractor, budget: int = 8192, s: Stream | None = None) -> dict[str, DataFrame]:
    """events, routes and records of message streams."""
    cited = evidence(messages, budget, s or Stream())
    events = parse.memory_events(written(extractor(manager.labelled_chunks(cited)), "answers"), cited)
    routes = route_kv.route_batches(events)
    return {"events": events, "routes": routes, "records": route_kv.records(routes)}


def extract_with_splits(cited: DataFrame, units: DataFrame, extractor: Extractor, max_depth: int = 12) -> DataFrame:
    """(sample, batch, part, answer, status): answers of chunks; a chunk whose answer is cut off is halved at a turn boundary
    and its halves are asked again, until they are whole (ok) or one turn is left (manager_output_unfit).

    units: sample, batch, evidence_id, turn. Each round asks for all cut chunks at once."""
    todo = cited.join(units, ["sample", "batch", "evidence_id"]).withColumn("part", F.lit("0"))
    done = None
    for depth in range(max_depth):
        key = F.concat_ws(":", "batch", "part")
        asked = todo.withColumn("_batch", F.col("batch")).withColumn("batch", key)
        answers = extractor(manager.labelled_chunks(asked))
        turns = asked.groupBy("sample", "batch").agg(F.count_distinct("turn").alias("turns"), F.min("_batch").alias("_batch"), F.min("part").alias("part"))
        got = turns.join(answers, ["sample", "batch"], "left").withColumn("cut", F.coalesce(parse.is_truncated("answer"), F.lit(False)))
        last = depth == max_depth - 1
        status = F.when(~F.col("cut"), "ok").when((F.col("turns") == 1) | F.lit(last), "manager_output_unfit")
        rows = got.withColumn("status", status)
        ended = rows.filter("status is not null").select("sample", F.col("_batch").alias("batch"), "part", "answer", "status")
        done = ended if done is None else done.unionByName(ended)
        open_ = rows.filter("status is null").select("sample", F.col("_batch").alias("batch"), "part", "turns")
        if last or open_.isEmpty():
            break
        place = F.dense_rank().over(Window.partitionBy("sample", "batch", "part").orderBy("turn"))
        half = F.when(F.col("_k") <= F.floor(F.col("turns") / 2), "0").otherwise("1")
        todo = todo.join(open_, ["sample", "batch", "part"]).withColumn("_k", place).withColumn("part", F.concat("part", half)).drop("_k", "turns")
    return done
