"""The similarity join and the containment join against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import contain, similar


@pytest.mark.parametrize("ratio", [0.82, 0.5, 0.95, 0.68])
def test_similar_pairs_equal_all_pairs(spark, ratio):
    rnd = random.Random(int(ratio * 100))

    def word():
        return "".join(rnd.choice("abcdeé🎉.") for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4, 5, 9, 14, 25])))

    left, right = [], []
    for _ in range(220):
        w = word()
        left.append((rnd.choice(["g", "g", "h", None]), w))
        for _ in range(2):  # a relative: letters dropped, added or moved
            x = [c for c in w if rnd.random() > 0.1]
            x.insert(rnd.randint(0, len(x)), rnd.choice("abz"))
            right.append((rnd.choice(["g", "g", "h", None]), "".join(x) if rnd.random() < 0.8 else w))
    left += [("g", None), ("g", ""), left[0]]
    right += [("g", ""), ("h", None)]
    a, b = spark.createDataFrame(left, "g string, a string"), spark.createDataFrame(right, "g string, b string")
    got = {(r.g, r.a, r.b): r.score for r in similar.similar_pairs(a, b, "g", ratio).collect()}
    want = {}
    for g, x in set(left):
        for h, y in set(right):
            if g is not None and g == h and x is not None and y is not None:
                score = difflib.SequenceMatcher(None, x, y).ratio()
                if score >= ratio:
                    want[g, x, y] = score
    assert got == want
    assert len(want) > 20


def test_similar_pairs_of_many_keys(spark):
    """5,000 keys on either side, 25 million pairs: few of them are compared."""
    rnd = random.Random(5)
    keys = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(16)) for _ in range(5_000)]
    torn = [k[:5] + k[6:] for k in keys]
    a, b = (spark.createDataFrame([("one", k) for k in ks], f"g string, {n} string") for ks, n in ((torn, "a"), (keys, "b")))
    found = similar.similar_pairs(a, b, "g", 0.82).cache()
    assert found.count() >= 5_000
    assert found.filter("score < 0.82").count() == 0
    assert found.join(spark.createDataFrame(list(zip(torn, keys, strict=True)), "a string, b string"), ["a", "b"]).count() == 5_000


def brute(needles, texts):
    return sorted((g, n, t) for g, n, s in needles for h, t, body in texts if g is not None and g == h and s and body is not None and s in body)


def test_containing_pairs_equal_all_pairs(spark):
    rnd = random.Random(8)
    vocabulary = ["al", "be", "ga", "delta", "é🎉", "日本語の長い文字列です", "om", "x"]
    bodies = [rnd.choice(["", " ", "\n"]).join(rnd.choice(vocabulary) + rnd.choice(["", " ", "  ", "\t"]) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts = [(rnd.choice(["g", "h", None]), k, body) for k, body in enumerate(bodies)] + [("g", 900, None), ("g", 901, "")]
    needles = []
    for k in range(150):
        body = rnd.choice(bodies)
        at, size = rnd.randint(0, max(0, len(body) - 1)), rnd.choice([1, 2, 3, 5, 9, 20, 60])
        needles.append((rnd.choice(["g", "h"]), k, body[at : at + size] if rnd.random() < 0.9 else "nowhere to be found at all"))
    needles += [("g", 500, None), ("g", 501, ""), ("g", 502, " "), (None, 503, "al"), ("none", 504, "al")]
    asked = spark.createDataFrame(needles, "g string, needle_id long, needle string")
    held = spark.createDataFrame(texts, "g string, text_id long, body string")
    got = sorted((r.g, r.needle_id, r.text_id) for r in contain.containing_pairs(asked, held, ["g"]).collect())
    assert got == brute(needles, texts)
    flat = [("", n, s) for _, n, s in needles], [("", t, body) for _, t, body in texts]
    got = sorted(("", r.needle_id, r.text_id) for r in contain.containing_pairs(asked.drop("g"), held.drop("g"), []).collect())
    assert got == brute(*flat)


def test_containing_pairs_of_nothing(spark):
    asked = spark.createDataFrame([(1, None), (2, "")], "needle_id long, needle string")
    held = spark.createDataFrame([(1, "x")], "text_id long, body string")
    assert contain.containing_pairs(asked, held, []).count() == 0
    assert contain.containing_pairs(asked.withColumn("needle", F.lit("x")), held.filter("false"), []).count() == 0
    one = contain.containing_pairs(asked.withColumn("g", F.lit(1)), held.withColumn("g", F.lit(1)), ["g"])
    assert one.count() == 0 and one.columns == ["g", "needle_id", "text_id", "needle", "body"]


def test_bounds():
    for ratio in (0.5, 0.68, 0.82, 0.95):
        for n in range(1, 30):
            for m in range(similar.least_partner(n, ratio), 60):
                assert m >= 1 and 2 * min(n, similar.least_partner(n, ratio)) >= ratio * (n + similar.least_partner(n, ratio)) - 1e-6
    assert similar.longest_short(0.82) == 2 and similar.longest_short(0.6) is None


@pytest.mark.parametrize("groups", [1, 200])
def test_few_strings_of_many_groups_are_compared_once(spark, groups, monkeypatch):
    """Pairs are those of all groups by brute force; with many groups, what meets holds no row per group."""
    keys = ["fact.location", "fact.loction", "fact.preference", "fact.prefeence", "event.meeting"]
    left = spark.createDataFrame([(g, k) for g in range(groups) for k in keys[1::2]], "g long, a string")
    right = spark.createDataFrame([(g, k) for g in range(groups) for k in keys if (g + len(k)) % 3], "g long, b string")
    seen, keep = {}, similar.written

    def noted(df, label):
        seen[label] = keep(df, label)
        return seen[label]

    monkeypatch.setattr(similar, "written", noted)
    got = sorted((r.g, r.a, r.b, r.score) for r in similar.similar_pairs(left, right, "g", 0.82).collect())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = [(g, a, b, ratio(a, b)) for g in range(groups) for a in keys[1::2] for b in keys if (g + len(b)) % 3 and ratio(a, b) >= 0.82]
    assert got == sorted(want) and got and seen["similar-met"].count() <= len(keys) ** 2
