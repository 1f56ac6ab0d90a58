"""A batch appears in all its tables or in none."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from palimpsest.sources.store import Store


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def seen(store, *tables):
    return [sorted(r.x for r in store.log(t).collect()) for t in tables]


def test_a_writer_that_dies_between_tables_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.append_batch(0, "h0", claims=rows(spark, 1, 2), edges=rows(spark, 3))
    broken = rows(spark, 5).withColumn("x", F.raise_error(F.lit("died")).cast("long"))
    with pytest.raises(Exception, match="died"):
        store.append_batch(1, "h1", claims=rows(spark, 4), edges=broken)
    assert (tmp_path / "claims" / "batch_id=1").exists()  # written, but nobody sees it
    assert seen(store, "claims", "edges") == [[1, 2], [3]]
    assert store.append_batch(1, "h1", claims=rows(spark, 4), edges=rows(spark, 5))
    assert seen(store, "claims", "edges") == [[1, 2, 4], [3, 5]]


def test_a_writer_that_dies_before_its_record_leaves_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr("palimpsest.sources.store.json", SimpleNamespace(dumps=lambda _: 1 / 0))
        with pytest.raises(ZeroDivisionError):
            store.append_batch(0, claims=rows(spark, 1))
    assert seen(store, "claims") == [[]]


def test_input_hash_guard(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.append_batch(7, "same", claims=rows(spark, 1))
    assert not store.append_batch(7, "same", claims=rows(spark, 1))
    with pytest.raises(ValueError, match="another input"):
        store.append_batch(7, "other", claims=rows(spark, 2))
    assert seen(store, "claims") == [[1]]
    assert [(r.batch_id, r.version, r.input_hash) for r in store.commits().collect()] == [(7, 1, "same")]


def test_a_batch_without_hash_replaces_itself(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append_batch(0, claims=rows(spark, 1), edges=rows(spark, 1))
    store.append_batch(0, claims=rows(spark, 2))
    store.append_batch(1, edges=rows(spark, 9))
    assert seen(store, "claims", "edges") == [[2], [1, 9]]
