"""Scans and sinks of question files, manifests and results."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, "
    "haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"
)


def questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Question rows of a JSON array file, or of JSON lines."""
    return spark.read.schema(QUESTION).option("multiLine", not lines).json(path)


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """Manifest rows of CSV files with headers, all text; an empty one is an error."""
    rows = spark.read.option("header", True).csv(list(paths))
    if rows.isEmpty():
        raise ValueError("the manifest is empty")
    return rows


def claimed_ids(spark: SparkSession, *paths: str) -> DataFrame:
    return manifest(spark, *paths).select("question_id").distinct()


def select_strict(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted rows; an id that isn't there is an error, and so is a repeated one."""
    if not wanted.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("an id is asked for twice")
    missing = wanted.join(rows, key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"missing ids: {[r[key] for r in missing]} and maybe more")
    return rows.join(wanted.select(key), key, "left_semi")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def html_report(rows: DataFrame, title: str, limit: int) -> str:
    """A page that shows up to ``limit`` rows, for review by eye."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows.limit(limit).toLocalIterator())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"


def markdown_audit(rows: DataFrame, key: str, limit: int) -> str:
    """A section per row, for review by eye."""
    parts = []
    for r in rows.limit(limit).toLocalIterator():
        parts.append(f"## {r[key]}\n\n" + "\n".join(f"- {c}: {r[c]}" for c in rows.columns if c != key))
    return "\n\n".join(parts) + "\n"


def fingerprint(config: dict) -> str:
    """The hash of what a run's results depend on; give it no transport settings."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def without_gold(samples: DataFrame) -> DataFrame:
    """The columns that a pipeline may see: no answers and no evidence marks."""
    bare = F.transform("haystack_sessions", lambda s: F.transform(s, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return samples.drop("answer", "answer_session_ids").withColumn("haystack_sessions", bare)
