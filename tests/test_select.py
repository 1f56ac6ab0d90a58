"""Selection by rank against sorting: ties, nulls, NaN, infinite and very large values, hot groups."""

import math
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evaluate
from palimpsest.operators.select import nth_values, smallest


def sorted_like_spark(values):
    return sorted(values, key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v)) if values and isinstance(values[0], float) else sorted(values)


def check(spark, groups: dict, kind: str, at_most: int, where=lambda n: n // 2):
    df = spark.createDataFrame([(g, v, "clash") for g, vs in groups.items() for v in vs], f"n string, k {kind}, lo string").repartition(5)
    rank = {g: where(len([v for v in vs if v is not None])) for g, vs in groups.items()}
    asked = spark.createDataFrame(list(rank.items()), "n string, want long")
    got = nth_values(df.withColumnsRenamed({"n": "g", "k": "v"}), "v", ["g"], lambda x: x.join(asked, F.col("g").eqNullSafe(asked["n"])).select("g", F.col("want").alias("k")), at_most)
    got = {r.g: (r["value"], r.below, r.n) for r in got.collect()}
    for g, vs in groups.items():
        known = sorted_like_spark([v for v in vs if v is not None])
        if not 0 <= rank[g] < len(known):
            assert g not in got
            continue
        want = known[rank[g]]
        value, below, n = got.pop(g)
        assert (math.isnan(value) and math.isnan(want)) if isinstance(want, float) and math.isnan(want) else value == want
        assert below == next(i for i, v in enumerate(known) if v == want or (isinstance(v, float) and math.isnan(v))) and n == len(known)
    assert not got


@pytest.mark.parametrize("at_most", [1, 7, 10_000])
def test_integers(spark, at_most):
    rng = random.Random(at_most)
    groups = {
        "one": [5], "same": [3] * 400, "none": [None, None], None: [rng.randint(-9, 9) for _ in range(300)],
        "hot": [rng.choice([7, 7, 7, rng.randint(-(10**6), 10**6)]) for _ in range(3000)],
        "wide": [rng.choice([-(2**63), 2**63 - 1, rng.randint(-(2**63), 2**63 - 1)]) for _ in range(300)],
        "high": [2**62 + rng.randint(0, 3) for _ in range(200)] + [None],
    }
    for where in (lambda n: n // 2, lambda n: 0, lambda n: n - 1, lambda n: n):
        check(spark, groups, "long", at_most, where)


@pytest.mark.parametrize("at_most", [1, 10_000])
def test_floats(spark, at_most):
    rng = random.Random(at_most)
    inf, nan = math.inf, math.nan
    groups = {
        "plain": [rng.gauss(0, 1) for _ in range(500)], "ends": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0], "tiny": [5e-324, 1e-323, 1.5e-323, 0.0],
        "odd": [rng.choice([inf, -inf, nan, 1.5, -2.5]) for _ in range(200)], "only": [inf, nan, nan, -inf], "tail": [rng.paretovariate(0.3) for _ in range(500)],
    }
    for where in (lambda n: n // 2, lambda n: 0, lambda n: n - 1):
        check(spark, groups, "double", at_most, where)


def test_medians_of_decimals_and_of_all(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "v long").select(F.col("v").cast("decimal(12,2)").alias("v"))
    assert [float(r.median) for r in evaluate.upper_median(df, "v").collect()] == [5.0]
    assert evaluate.upper_median(df.limit(0), "v").collect() == []
    with pytest.raises(ValueError, match="no number"):
        evaluate.upper_median(df.select(F.col("v").cast("string")), "v")


@pytest.mark.parametrize("at_most", [1, 10_000])
def test_picks_equal_sorting_by_hash(spark, at_most):
    rng = random.Random(2)
    rows = [(rng.randint(0, 400), rng.choice(["a", "a", "b", None]), rng.random()) for _ in range(1500)] + [(9, "a", 0.0)] * 300  # repeated rows
    df = spark.createDataFrame(rows, "id long, kind string, _h double").repartition(6)
    quotas = {"a": 700, "b": 40, None: 1, "absent": 3}
    got = smallest(df, "id", "kind", 4, spark.createDataFrame(list(quotas.items()), "stratum string, quota long"), at_most)
    got = sorted((str(r.stratum), r.id) for r in got.collect())
    want = []
    for s, quota in quotas.items():
        own = sorted((sha256(f"4:{k}".encode()).hexdigest(), k) for k, kind, _ in rows if kind == s)
        want += [(str(s), k) for _, k in own[:quota]]
    assert got == sorted(want)


def test_picks_of_every_size(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("kind"))
    picked = evaluate.stratified_pick(df, "id", "kind", 100, 1)
    assert picked.count() == 100 and picked.select("id").distinct().count() == 100
    assert evaluate.stratified_pick(df, "id", "kind", 5000, 1).count() == 1000
    assert evaluate.stratified_pick(df.limit(0), "id", "kind", 5, 1).count() == 0
