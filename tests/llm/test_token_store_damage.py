"""What the token store gives back, and that it notices what was changed in its files."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def store(spark):
    texts = [None, "", "one two three " * 400, "one two three " * 400, "four", "long " * 9000]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(None, "none", "x"), (4, "four", "x")], "doc_id long, text string, part string")
    return docs, token_store.write_store(docs, PATH)


def test_ids_come_back(spark, store):
    docs, path = store
    t = Tokenizer.from_file(PATH)
    expected = sorted((repr(r.doc_id), [*t.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    assert sorted((repr(r.doc_id), r.ids) for r in token_store.read_ids(spark, path).collect()) == expected


def damaged(spark, path, to, table, change):
    for name in ("data", "recipes", "manifest"):
        df = spark.read.parquet(f"{path}/{name}")
        writer = (change(df) if name == table else df).write
        (writer.partitionBy("kind") if name == "data" else writer).parquet(f"{to}/{name}")
    return str(to)


@pytest.mark.parametrize(
    ("table", "change"),
    [
        ("recipes", lambda df: df.withColumn("doc_id", F.col("doc_id") + 1)),
        ("recipes", lambda df: df.withColumn("digests", F.reverse("digests"))),
        ("recipes", lambda df: df.filter("doc_id <> 1")),
        ("manifest", lambda df: df.withColumn("root", F.when(F.col("part").isNotNull(), F.col("root")).otherwise(F.unhex(F.lit("00"))))),
        ("data", lambda df: df.withColumn("payload", F.when(F.length("payload") > 100, F.reverse(F.hex("payload")).cast("binary")).otherwise(F.col("payload")))),
        ("data", lambda df: df.filter("kind = 1 or length(payload) < 100")),
    ],
)
def test_damage_is_an_error(spark, store, tmp_path, table, change):
    path = damaged(spark, store[1], tmp_path, table, change)
    with pytest.raises(Exception, match="manifest names|does not hold|missing|size"):
        token_store.read_store(spark, path).collect()
