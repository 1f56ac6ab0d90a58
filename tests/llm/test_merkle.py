"""Merkle proofs against a tree built level by level in lists."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import merkle, prefix, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string, key long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fanout):
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, j in enumerate(at):
            run = level[j // fanout * fanout : (j // fanout + 1) * fanout]
            paths[i].append(("".join(run[: j % fanout]), "".join(run[j % fanout + 1 :])))
        at = [j // fanout for j in at]
        level = [h("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout):
    groups = {}
    for group, key, leaf in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([m[2] for m in sorted(groups[g], key=lambda m: m[:3])], fanout) for g in names}
    root, tops = tree([made[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops, strict=True):
        for m, path in zip(sorted(groups[g], key=lambda m: m[:3]), made[g][1], strict=True):
            out.append((g, m[3], m[2], made[g][0], root, path + top))
    return out


def docs_of(n):
    rows = [(i * 3, None if i % 11 == 0 else "" if i % 13 == 0 else f"s{i % 37}" if i % 3 else "hot", None, i, f"Text ÄÖ {i}", "x", "y", 1) for i in range(n)]
    odd = [(None, "hot", "en", None, None, None, None, None), (None, None, None, None, "", None, None, None), (1, "alone", "fr", 2, "Z" * 100_000, "l", "p", 2)]
    return [*rows, *odd, rows[4], rows[4], rows[4], (rows[6][0], "hot", "de", 1, "another text of one id", "", "", 0)]


def text_of(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.mark.parametrize("n, fanout, part_rows", [(400, 16, 50_000), (400, 16, 13), (400, 2, 50), (90, 3, 7), (0, 16, 5)])
def test_proofs_equal_lists(spark, monkeypatch, n, fanout, part_rows):
    monkeypatch.setattr(prefix, "PART_ROWS", part_rows)
    rows = docs_of(n) if n else docs_of(10)[-1:]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = merkle.proofs(docs, F.col("source"), F.col("doc_id"), merkle.leaf_digest(*map(F.col, queries.LEAF_COLUMNS)), fanout=fanout)
    got = [(r.group, r.key, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in found.collect()]
    leaves = [(r[1], r[0], h("".join(text_of(r[k]) for k in (0, 1, 2, 3, 4)))) for r in rows]
    assert sorted(got, key=repr) == sorted(brute(leaves, fanout), key=repr)
    assert found.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert found.filter(merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0


def test_query_finds_tampered_rows(spark, tmp_path):
    """verified fails exactly where lower-casing changed a text; no letters, null texts and null ids pass."""
    import zlib

    docs = spark.createDataFrame(docs_of(120), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_merkle(spark, str(tmp_path)).collect()
    failed = sorted(r.doc_id for r in rows if not r.verified)
    hit = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    assert failed == sorted(r[0] for r in docs_of(120) if hit(r[0]) and r[4] and r[4].encode() != r[4].encode().lower())
    assert len(rows) == len(docs_of(120))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    found = merkle.proofs(docs, F.col("source"), F.col("doc_id"), merkle.leaf_digest(F.col("text")))
    assert found.count() == 0


def test_spans_of_partitions():
    a, b, c = b"a", b"b", b"c"
    found, most = merkle.spans([(2, 1, [[b, 5]]), (0, 2, [[a, 3], [b, 2]]), (3, 3, [[b, 1], [c, 4]])])
    assert most == 8
    assert found[0] == merkle.Span(2, 0, 3, 8) and found[2] == merkle.Span(1, 2, 8, 8) and found[3] == merkle.Span(3, 7, 8, 4)
