"""Decontamination against windows at every start."""

import random
import re

import pytest

from palimpsest.llm import decontaminate


def every_window(rows, items):
    """Best similarity and number of matching starts over all windows of an item's size, without SimHash."""
    tok = lambda s: [w for w in re.split(r"[\W_]+", (s or "").lower()) if w]
    weigh = lambda b: sum(sum(map(len, x)) for x in b)
    out = {}
    for d, text in rows:
        words = tok(text)
        for i, item in items:
            iw = tok(item)
            size = min(5, len(iw))
            bag = lambda w: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]  # noqa: E731,B023
            ib = bag(iw)
            for s in range(max(0, len(words) - len(iw)) + 1):
                wb = bag(words[s : s + len(iw)])
                common = sum(min(wb.count(x), ib.count(x)) * sum(map(len, x)) for x in set(wb))
                score = 2 * common / (weigh(wb) + weigh(ib))
                if score >= 0.8:
                    best, n = out.get((d, i), (0, 0))
                    out[d, i] = max(best, score), n + 1
    return out


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_SHINGLES, 0])
def test_decontaminate_tries_every_start(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", broadcast)
    rnd = random.Random(11)
    some = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n)]
    passages = [some(n) for n in (12, 30, 45, 60)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)]
    rows = []
    for p in passages:
        third, half = len(p) // 3, len(p) // 2
        for text in (p, p[half:] + p[:half], p[2 * third :] + p[third : 2 * third] + p[:third], p[: half + 5], p[3:], p[:half] + some(1) + p[half:], p[:half] + some(6) + p[half:]):
            rows.append((len(rows), " ".join([*some(40), *text, *some(40)])))
            rows.append((len(rows), " ".join(text)))
    expected = every_window(rows, items)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.n_windows) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == set(expected)
    assert all(abs(got[k][0] - expected[k][0]) < 1e-9 and got[k][1] == expected[k][1] for k in got)
    # the halves of the longer passages are swapped in rows 16, 30 and 44
    assert {(16, 1), (30, 2), (44, 3)} <= set(got)
