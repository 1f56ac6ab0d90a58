"""Mixing against a serial fill of the budgets, on rows with nulls, repeats and clashing columns."""

import hashlib
import random
import re

import pytest

from palimpsest.llm import mixing, prefix

SCHEMA = "doc_id long, source string, text string, size long, key string, carried string, _at long, _part long"


def rows_of(n=160):
    rnd = random.Random(4)
    out = []
    for i in range(n):
        text = rnd.choice([None, "", " \n\t", "a" * 500, " ".join("wö rd".split() * rnd.randint(1, 30)), "x " * rnd.randint(1, 400)])
        out.append((i, rnd.choice(["hot", "hot", "hot", "b", "", None, f"s{i % 7}"]), text))
    out += [out[3], out[3], out[5], (None, "hot", "no id here"), (None, None, "x y"), (None, "hot", None), (7, "other", "same id"), (1, "empty", "")]
    return [(*r, 9, "k", None, 1, 2) for r in out]


def levels(sizes, weights, share, most):
    """Targets by resharing what limited sources can't take, until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        left = [s for s in names if s not in fixed]
        rest = budget - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if target[s] > most * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: most * sizes[s] for s in over}


def expected(rows, weights=(5, 2, 1), share=1.5, most=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = {}
    for d, s, t, *_ in rows:
        key = hashlib.md5(f"11:{'-' if d is None else d}".encode()).hexdigest()
        sources.setdefault(s, []).append((key, d, size(t)))
    own = {s: sum(x[2] for x in m) for s, m in sources.items()}
    targets, out = levels(own, weights, share, most), []
    for s, members in sources.items():
        budget = int(targets[s] + 1e-9)
        epochs = budget // own[s] if own[s] else 0
        rest = budget - epochs * own[s]
        for _, d, n in sorted(members, key=lambda m: (m[0], m[2])):
            take = min(max(rest, 0), n)
            rest -= take
            out.append((d, n, own[s], round(targets[s], 6), epochs * n + take))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_rows", [50_000, 11])
def test_mix_equals_a_serial_fill(spark, monkeypatch, part_rows):
    monkeypatch.setattr(prefix, "PART_ROWS", part_rows)
    rows = rows_of()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got], key=repr) == expected(rows)
    assert all(r.taken <= 2 * r["size"] for r in got)


@pytest.mark.parametrize("weights, share, most", [((1,), 1.0, 1), ((1, 9), 0.3, 3), ((5, 2, 1), 2.0, 2)])
def test_other_weights_and_budgets(spark, weights, share, most):
    rows = rows_of(60)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, share, most).collect()
    assert sorted([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got], key=repr) == expected(rows, weights, share, most)


def test_mixed_texts_hold_what_is_taken(spark):
    rows = rows_of(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    texts = mixing.mixed_texts(docs).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in texts) == sum(r.words for r in texts) == taken
    whole = {r[2] for r in rows}
    cut = [r for r in texts if r.text not in whole]
    assert all(any(t and t.split()[: r.words] == r.text.split() for t in whole) for r in cut)
    assert len(cut) <= len({r[1] for r in rows})


def test_empty_tables_and_empty_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_many_sources_and_equal_rows_are_spread(spark, monkeypatch):
    """Prefix sums of the sources themselves, and of one row that repeats, over many parts."""
    monkeypatch.setattr(prefix, "PART_ROWS", 20)
    rows = [(5, "hot", "a b c")] * 150 + [(i, f"s{i:04}", "w " * (i % 9)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert sorted([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got], key=repr) == expected(rows)
