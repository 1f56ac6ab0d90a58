"""The pipeline against brute force on the smallest tables, and stage by stage on edge rows."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_texts import brute_kept
from tests.llm.test_operators import brute_base, brute_contaminated, brute_grams, brute_strange

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted((a, -b, k) for k, a, b in brute_base(text))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"<{kind}>"
        at = max(at, -b)
    return out + text[at:]


def expected_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    learned = [(r.lang, r.text) for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    grams = brute_grams(learned)
    docs = [(r.doc_id, r.text) for r in rows if any(c.isalpha() for c in r.text or "")]
    docs = [(d, t) for d, t in docs if not brute_strange(t, grams)]
    # groups of texts with a five-word Jaccard of 0.8 or more, as the stage is bound to
    keep = set(brute_kept(docs))
    docs = [(d, t) for d, t in docs if d in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contaminated(docs, items)}
    assert bad
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, t in docs:
        if d not in bad:
            text = redacted(t)
            ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            out.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == expected_rows(spark, SF)


def test_stages_on_edge_rows(spark):
    rows = [(1, "hello there", "en", "s", 11), (1, "hello there", "en", "s", 11), (2, None, "en", "s", 0), (3, "", None, None, None), (None, "more words here", None, None, None), (4, "hello there", "en", "s", 11), (5, "mail a@b.example.com", "en", "s", 20)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "bpe":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted((r.doc_id or -1, r.n_tokens > 0) for r in docs.collect()) == [(-1, True), (1, True), (5, True)]
    empty = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
