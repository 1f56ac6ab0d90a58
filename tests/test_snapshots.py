"""Chains, states and resumed runs against full runs on random traces."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import route_kv, snapshots
from palimpsest.operators.rolling import replay_identical

SCHEMA = "sample string, key string, action string, memory_type string, value string, status string, batch long, item long"


def trace(seed, samples=5, batches=8):
    rng, rows = random.Random(seed), []
    for s in [*(f"s{i}" for i in range(samples - 1)), None]:
        for b in range(batches):
            for i in range(rng.randint(0, 4)):
                rows.append((s, f"k{rng.randint(0, 3)}", rng.choice(["ADD", "ADD", "UPDATE", "UPDATE", "NOOP"]), rng.choice(["fact", "fact", "event"]), rng.choice(["1", "2", None]), "active", b, i))
    return rows


def edited(rows, seed):
    """Another run's input: each sample is changed in its own way."""
    rng, out = random.Random(seed), []
    for r in rows:
        s, b = r[0], r[6]
        if s == "s0":  # unchanged
            out.append(r)
        elif s == "s1" and b >= 4:  # stops earlier
            continue
        elif s == "s2" and b == 3:  # a batch is missing
            continue
        elif s == "s3" and b >= 5:  # other values
            out.append((*r[:4], rng.choice(["1", "2", "3"]), *r[5:]))
        elif s is None:  # differs from the start
            out.append((*r[:4], "9", *r[5:]))
        else:
            out.append(r)
    return out + [("new", "k0", "ADD", "fact", "1", "active", 0, 0)]


@pytest.mark.parametrize("route", [route_kv.route_batches, route_kv.route_immediate])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_resumed_run_equals_a_full_run(spark, route, seed):
    rows = trace(seed)
    old, new = (spark.createDataFrame(x, SCHEMA) for x in (edited(rows, seed), rows))
    for before, now in ((old, new), (new, old), (new, new), (old.limit(0), new)):
        common = snapshots.agreed(snapshots.input_chain(before), snapshots.input_chain(now))
        assert replay_identical(snapshots.resumed(now, route(before), common, route).select(route(now).columns), route(now))


def test_only_changed_batches_run_again(spark):
    rows = trace(4)
    old, new = (spark.createDataFrame(x, SCHEMA) for x in (edited(rows, 4), rows))
    common = snapshots.agreed(snapshots.input_chain(old), snapshots.input_chain(new))
    got = {r["sample"]: r.upto for r in common.collect()}
    batches = {s: sorted({r[6] for r in rows if r[0] == s}) for s in {r[0] for r in rows}}
    assert got["s0"] == batches["s0"][-1] and None not in got
    for s, first in (("s1", 4), ("s2", 3)):
        assert got.get(s) == max((b for b in batches[s] if b < first), default=None)
    assert got["s3"] >= max(b for b in batches["s3"] if b < 5)
    asked = []

    def watched(events):
        asked.extend(r["sample"] for r in events.filter("not _old").collect())
        return route_kv.route_batches(events)

    snapshots.resumed(new, route_kv.route_batches(old), common, watched).count()
    assert "s0" not in asked and "s1" in asked


def test_the_chain_is_the_chain(spark):
    rows = trace(5, samples=3)
    got = {(r["sample"], r.batch): r.hash for r in snapshots.input_chain(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    names = SCHEMA.replace(" string", "").replace(" long", "").split(", ")
    for s in {r[0] for r in rows}:
        before = ""
        for b in sorted({r[6] for r in rows if r[0] == s}):
            texts = [json.dumps({k: v for k, v in sorted(zip(names, r, strict=True)) if v is not None}, separators=(",", ":")) for r in sorted((r for r in rows if r[0] == s and r[6] == b), key=lambda r: r[7])]
            digest = hashlib.sha256("".join(hashlib.sha256(t.encode()).hexdigest() for t in texts).encode()).hexdigest()
            before = hashlib.sha256(f"{before}:{digest}".encode()).hexdigest()
            assert got.pop((s, b)) == before
    assert not got


@pytest.mark.parametrize("every", [1, 3])
def test_states_equal_runs_that_stop_there(spark, every):
    rows = trace(6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["sample"], r.batch): r for r in snapshots.states(route_kv.route_batches(df), every).collect()}
    for s in {r[0] for r in rows}:
        batches = sorted({r[6] for r in rows if r[0] == s})
        for b in [b for i, b in enumerate(batches, 1) if i % every == 0 or i == len(batches)]:
            upto = spark.createDataFrame([r for r in rows if r[0] == s and r[6] <= b], SCHEMA)
            memory = route_kv.records(route_kv.route_batches(upto)).orderBy("batch", "item").collect()
            want = [{c: r[c] for c in snapshots.SHOWN if r[c] is not None} for r in memory]
            state = got.pop((s, b))
            assert json.loads(state.state) == {"records": want} and state.active == sum(r["status"] == "active" for r in want)
            assert state.state_hash == hashlib.sha256(state.state.encode()).hexdigest()
    assert not got


def test_answers_replay_from_a_snapshot(spark):
    df = spark.createDataFrame(trace(7), SCHEMA)
    routed = route_kv.route_batches(df)
    at = df.select("sample", F.lit(4).alias("batch")).distinct()
    stopped = route_kv.records(route_kv.route_batches(df.filter("batch <= 4")))
    assert replay_identical(route_kv.answer_memory(snapshots.records_at(routed, at)), route_kv.answer_memory(stopped))


def test_compactions_are_taken_for_equal_memory_only(spark):
    memory = spark.createDataFrame([("a", "m"), ("b", "m2"), ("c", "m"), ("d", "m")], "sample string, memory string")
    digest = hashlib.sha256(b"m").hexdigest()
    stored = spark.createDataFrame([("a", digest, "ok", "x"), ("b", digest, "ok", "x"), ("c", digest, "rejected_parse", None)], "sample string, memory_hash string, parse_status string, summary string")
    got = {r["sample"]: r.outcome for r in snapshots.compaction_checks(memory, stored, memory).collect()}
    assert got == {"a": "reused", "b": "memory_changed", "c": "not_parsed", "d": "missing"}
