"""The pipeline's near-dedup against all pairs by brute force."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from palimpsest.llm import near_texts

SF = "/root/testdata/sf0.01"


def brute_kept(rows):
    sets = {}
    for d, text in rows:
        w = (text or "").lower().split()
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), []).append(d)
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    each = list(sets)
    for i, a in enumerate(each):
        for b in each[:i]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(a)] = find(b)
    low = {}
    for s, ids in sets.items():
        low[find(s)] = min([*ids, *([low[find(s)]] if find(s) in low else [])])
    return sorted(low.values())


def test_near_dedup_links_all_pairs_at_08(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect())
    assert kept == brute_kept(rows)
    assert len(kept) == 922


def test_near_dedup_chains_and_groups(spark):
    """Edited copies at many distances, chains without a common leader, and a large group of copies."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    texts = ["", "one", "one two three four", "one two three four five"]
    for _ in range(25):
        words = [word() for _ in range(rnd.choice([8, 30, 90, 300]))]
        for _ in range(rnd.choice([1, 3, 40])):
            texts.append(" ".join(words))
            words = [w if rnd.random() > 0.012 else word() for w in words]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert kept == brute_kept(rows)


def test_parity_sketches_never_exclude_a_link():
    """Pairs around 0.8, of few and of many shingles: what the bound excludes is below 0.8; short pairs far below it go."""
    rnd = np.random.default_rng(3)
    excluded = 0
    for size in (1, 9, 45, 150, 3000):
        for _ in range(60):
            base = rnd.integers(0, 1 << 63, size, np.uint64)
            fresh = rnd.integers(0, 1 << 63, size, np.uint64)
            a = np.unique(base)
            b = np.unique(np.where(rnd.random(size) < rnd.choice([0.05, 0.1, 0.12, 0.3]), fresh, base))
            odd = [np.frombuffer(near_texts.parity(x), "<u8") for x in (a, b)]
            differ = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
            common = len(np.intersect1d(a, b))
            if 9 * differ > len(a) + len(b):
                excluded += 1
                assert 9 * common < 4 * (len(a) + len(b))
            else:
                assert size > 1000 or common > 0.65 * len(a)
    assert excluded > 60


def test_near_dedup_of_a_family_around_the_threshold(spark):
    """Copies of one text that are edited on their own: some reach 0.8 with each other, most don't, all share buckets."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(140)]
    edited = [" ".join(w if rnd.random() > share else word() for w in base) for share in (0.01, 0.02, 0.03) for _ in range(80)]
    rows = list(enumerate([" ".join(base), *edited]))
    found = near_texts.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted({r.component_id for r in found}) == brute_kept(rows)
    assert len(found) == len(rows)


def test_near_dedup_of_texts_whose_partners_another_leader_absorbs(spark):
    """A family of short copies around b, and a text near b alone: too long for the copies, so they never lead to it."""
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    texts, late = [], []
    for _ in range(20):
        b = [word() for _ in range(200)]
        copies = [" ".join(b[:k] + b[k + 35 :]) for k in range(0, 165, 4)]
        late.append((len(texts) + len(copies), len(texts) + len(copies) + 1))
        texts += [*copies, " ".join(b), " ".join(b + [word() for _ in range(45)])]
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component_id for r in near_texts.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(set(found.values())) == brute_kept(rows)
    assert all(found[b] == found[a] for b, a in late)


def test_near_texts_of_an_empty_table_and_clashing_columns(spark):
    names = "doc_id long, text string, cls string, n string, keys string, component_id string, key string"
    assert near_texts.near_texts(spark.createDataFrame([], names)).count() == 0
    rows = [(1, "a b c d e f", "x", "y", "z", "w", "k"), (2, "A b c  d e f", *[None] * 5), (3, None, *[None] * 5), (4, " ", *[None] * 5)]
    found = near_texts.near_texts(spark.createDataFrame(rows, names)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_candidates_come_from_simhash_words():
    """Words are majorities of bits of each shingle's hashes; pairs at 0.8 are candidates by a segment and the next word."""
    rnd = np.random.default_rng(5)
    for size in (0, 3, 4, 8, 9, 255, 256, 700):
        hashes = rnd.integers(0, 1 << 63, size, np.uint64)
        words = near_texts.simhashes(hashes)
        assert len(words) == (0 if size < 4 else 64 if size <= 8 else 32)
        if size > 3:
            alone = [[int(w) for w in near_texts.simhashes(np.repeat(h, size))] for h in hashes]
            for t in (0, 17, 31):
                assert int(words[t]) == sum(1 << b for b in range(64) if 2 * sum(w[t] >> b & 1 for w in alone) > size)
    for common, left, right in ((4, 0, 1), (8, 1, 1), (80, 10, 10), (320, 0, 80)):
        for _ in range(100):
            h = rnd.integers(0, 1 << 63, common + left + right, np.uint64)
            a, b = near_texts.simhashes(h[: common + left]), near_texts.simhashes(np.r_[h[:common], h[common + left :]])
            rings = [(a[t] ^ b[t], a[t - t % 32 + (t + 1) % 32] ^ b[t - t % 32 + (t + 1) % 32]) for t in range(min(len(a), len(b)))]
            assert any(int(y).bit_count() <= 16 and any(int(x) >> s & 0xFFFF == 0 for s in (0, 16, 32, 48)) for x, y in rings)


def test_a_bucket_is_left_by_its_candidates_only():
    """Texts that agree in a segment but not in the next word, or whose sizes rule 0.8 out, are in no pair."""
    bucket, words = 7 << near_texts.WIDTH << near_texts.SIZE_BITS, [0, 0xFFFF, 0x1FFFF, -1, -1]
    batch = pa.record_batch([pa.array([bucket | n for n in (80, 90, 90, 100, 126)]), pa.array([1, 2, 3, 4, 5]), pa.array(words)], names=["key", "cls", "word"])
    rows = [r for out in near_texts._bucket_batches(iter([batch.slice(0, 2), batch.slice(2)])) for r in zip(*out.to_pydict().values(), strict=True)]
    assert rows == [(1, 2), (3, 3)]
