"""Rolling summaries with list state: restarts from a checkpoint, what the state holds, late messages."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from palimpsest.operators import rolling
from palimpsest.operators.stream import Stream
from palimpsest.streaming.rolling import running_states, running_tails, stream_compressions

BUDGETS = rolling.Budgets(60, 24)
SCHEMA = "talk string, n long, role string, body string, day long, stamp string"
TALKS = Stream("talk", "n", "role", "body", "day", "stamp")


def talks(spark, seed: int, streams: int = 6, length: int = 40):
    rng, rows = random.Random(seed), []
    for t in range(streams):
        day = 0
        for n in range(length):
            day += rng.random() < 0.2
            role = "user" if t == 0 else rng.choice(["user", "assistant", "assistant"])  # the first has no legal cut
            body = None if rng.random() < 0.05 else " ".join(["w"] * rng.randint(0, 30))
            rows.append((f"t{t}", n, role, body, day, f"2023/05/{day + 1:02d} (Mon) 10:00"))
    return spark.createDataFrame(rows, SCHEMA)


def run_all(spark, df, place, budgets=BUDGETS) -> None:
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    out = stream_compressions(source, budgets, s=TALKS).writeStream.format("parquet").outputMode("append")
    q = out.option("checkpointLocation", f"{place}/cp").option("path", f"{place}/out").trigger(availableNow=True).start()
    q.awaitTermination()


def test_restart_from_a_checkpoint_gives_the_batch_rows(spark, tmp_path):
    df = talks(spark, 3)
    for k in range(4):  # two batches, a stop, two more
        df.filter(F.floor(F.col("n") / 10) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k % 2:
            run_all(spark, df, tmp_path)
    want = rolling.compressions(df, BUDGETS, s=TALKS)
    assert want.count() > 20
    assert rolling.replay_identical(spark.read.parquet(f"{tmp_path}/out"), want)

    cp = f"{tmp_path}/cp"
    got = {r.talk: r for r in running_states(spark, cp, "talk").collect()}
    for r in rolling.final_states(df, BUDGETS, s=TALKS).collect():
        now = got.pop(r.talk)
        assert (now.summary, now.summary_tokens, now.tail_messages, now.history_tokens) == (r.summary, r.summary_tokens, r.tail_messages, r.history_tokens)
    assert not got
    tails = rolling.true_tails(df, want, s=TALKS).select("talk", F.col("n").alias("ordinal"), "role")
    assert rolling.replay_identical(running_tails(spark, cp, "talk").select("talk", "ordinal", "role"), tails)


def test_a_batch_without_a_compression_appends_only_its_messages(spark, tmp_path):
    df = talks(spark, 4, streams=2, length=20)
    for k in range(2):
        df.filter(F.floor(F.col("n") / 10) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run_all(spark, df, tmp_path, rolling.Budgets(10**6, 10**5))
    assert spark.read.parquet(f"{tmp_path}/out").isEmpty()
    changes = spark.read.format("statestore").option("stateVarName", "tail").option("readChangeFeed", True).option("changeStartBatchId", 0).load(f"{tmp_path}/cp")
    assert {(r.batch_id, r.change_type) for r in changes.collect()} == {(0, "append"), (1, "append")}  # nothing was put anew
    assert running_tails(spark, f"{tmp_path}/cp", "talk").count() == 40


def test_a_late_message_is_an_error(spark, tmp_path):
    df = talks(spark, 5, streams=1, length=10)
    for part in (F.col("n") > 4, F.col("n") <= 4):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if tmp_path.joinpath("cp").exists():
            with pytest.raises(StreamingQueryException, match="comes after"):
                run_all(spark, df, tmp_path)
        else:
            run_all(spark, df, tmp_path)
