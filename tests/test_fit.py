"""Fitting contexts against trying every combination in order."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunk, fit

LIMITS = chunk.degraded_limits(640, 480)


def size(lines):
    return sum(len((x or "").split()) for x in lines)


def brute(fixed, records, ledger, units, budget):
    """Combination by combination: limits first, then the tail from whole to none."""
    for i, (n, per_key) in enumerate(LIMITS):
        last = i == len(LIMITS) - 1
        newest = sorted(records, key=lambda r: (-r[0], r[1] or ""))[:n]
        shown, seen = [], {}
        for key, seq, line in sorted(ledger, key=lambda u: (-u[1], u[2] or "")):
            seen[key] = seen.get(key, 0) + 1
            if seen[key] <= per_key:
                shown.append((seq, line))
        base = fixed + size(x[1] for x in newest) + size(x[1] for x in shown)
        if base > budget and not last:
            continue
        for first in range(len(units) + 1):
            tail = units[first:]
            total = base + size(x for u in tail for x in u)
            if total <= budget or first == len(units):
                text = ["\n".join(x for _, x in sorted(rows) if x is not None) for rows in ([r for r in newest if r[1] is not None], [u for u in shown if u[1] is not None])]
                return i + 1, *text, "\n".join(x for u in tail for x in u if x is not None), len(tail), total, total <= budget


@pytest.mark.parametrize("budget", [0, 12, 40, 90, 400])
def test_all_combinations(spark, budget):
    rng = random.Random(budget)
    line = lambda: None if rng.random() < 0.05 else " ".join(rng.choices("abcdef", k=rng.randint(0, 9)))
    prompts, records, ledger, tail, want = [], [], [], [], {}
    for s in [*(f"s{i}" for i in range(12)), None]:
        r = [(i, line()) for i in range(rng.choice([0, 3, 20]))]
        u = [(f"k{rng.randint(0, 2)}", i, line()) for i in range(rng.choice([0, 2, 25]))]
        t = [[line() for _ in range(rng.randint(1, 2))] for _ in range(rng.choice([0, 1, 12]))]
        fixed = rng.choice([0, 5, 30])
        prompts.append((s, fixed))
        records += [(s, *x) for x in r]
        ledger += [(s, *x) for x in u]
        tail += [(s, i, j, x) for i, unit in enumerate(t) for j, x in enumerate(unit)]
        want[s] = brute(fixed, r, u, t, budget)
    frames = (
        spark.createDataFrame(prompts, "sample string, fixed long"), spark.createDataFrame(records, "sample string, seq long, line string"),
        spark.createDataFrame(ledger, "sample string, key string, seq long, line string"), spark.createDataFrame(tail, "sample string, unit long, place long, line string"),
    )
    rows = fit.fitted_context(*frames, LIMITS, budget).collect()
    assert {r["sample"]: (r.choice, r.memory, r.ledger, r.tail, r.units, r.tokens, r.fits) for r in rows} == want
    limits = fit.fitting_limits(*frames[:3], LIMITS, budget).collect()
    assert {r["sample"]: (r.choice, r.records, r.updates) for r in limits} == {s: (w[0], *LIMITS[w[0] - 1]) for s, w in want.items()}


def test_limits_must_fall(spark):
    empty = spark.createDataFrame([], "sample string, fixed long")
    lines = spark.createDataFrame([], "sample string, key string, seq long, line string")
    with pytest.raises(ValueError, match="none may grow"):
        fit.fitting_limits(empty, lines, lines, [(1, 0), (2, 0)], 5)
    assert fit.fitting_limits(empty, lines, lines, [(1, 0)], 5).collect() == []


def test_memory_is_never_cut(spark):
    rows = [("all", 1, "a b", "x  y\nz"), ("some", 4, "a b", "x y z"), ("none", 6, "a b", "x y z"), ("over", 7, "a b", "x"), ("null", None, None, None)]
    got = {r["sample"]: (r.memory, r.tail, r.tail_tokens, r.fits) for r in fit.memory_then_tail(spark.createDataFrame(rows, "sample string, fixed int, memory string, tail string"), 10, 2).collect()}
    assert got == {"all": ("a b", "x  y\nz", 3, True), "some": ("a b", "y z", 2, True), "none": ("a b", "", 0, True), "over": ("a b", "", 0, False), "null": ("", "", 0, True)}


def test_another_counter(spark):
    prompts = spark.createDataFrame([("s", 0)], "sample string, fixed long")
    records = spark.createDataFrame([("s", 1, "abcd"), ("s", 2, "ef")], "sample string, seq long, line string")
    ledger = spark.createDataFrame([], "sample string, key string, seq long, line string")
    got = fit.fitting_limits(prompts, records, ledger, [(2, 0), (1, 0)], 5, F.char_length).collect()
    assert [(r.choice, r.tokens) for r in got] == [(2, 2)]
