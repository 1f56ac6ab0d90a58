"""Containment join: which texts hold which strings, by rare anchors.

A string's anchors are the runs of up to three words inside it (its outer words may be parts of longer ones in a text), or,
if it has no inner word, its runs of 8, 4, 2 or 1 characters. A text that holds the string holds all of them. Texts are
taken apart into hashes of such runs, of which only those that some string asks for are kept, with the text's id and nothing
else. A string then asks for its rarest anchor alone; bodies are fetched for the pairs that this gives and searched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written

#: Words of an anchor at most, and characters of one where a string has no inner word.
WORDS, CHARS = 3, (8, 4, 2, 1)


def _words(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def _runs(parts: Column, size: int, blank: str) -> Column:
    """Distinct hashes of every ``size`` neighbours."""
    count = F.size(parts) - size + 1
    runs = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.lit(size), F.array_join(F.slice(parts, i, size), blank)))
    return F.when(count > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _anchors(rows: DataFrame, keep: list[str], text: str, inner: bool, kind: str) -> DataFrame:
    """(keep, kind, h): the anchors of one kind that a column has. The text is taken apart in a column of its own, so that
    it is done once and not for each run."""
    size = int(kind[1:])
    if kind[0] == "c":
        parts = F.split(F.col(text), "")
    else:
        parts = _words(F.col(text))
        if inner:
            parts = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
    split = rows.select(*keep, parts.alias("_parts"))
    return split.select(*keep, F.lit(kind).alias("kind"), F.explode(_runs(F.col("_parts"), size, " " if kind[0] == "w" else "")).alias("h"))


def _kind(needle: str) -> Column:
    inner = F.size(_words(F.col(needle))) - 2
    out = F.when(inner >= WORDS, f"w{WORDS}")
    for k in range(WORDS - 1, 0, -1):
        out = out.when(inner >= k, f"w{k}")
    for q in CHARS:
        out = out.when(F.char_length(needle) >= q, f"c{q}")
    return out


def containing_pairs(needles: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """(on, needle_id, text_id, needle, body): a row for each text of ``texts`` (on, text_id, body) that holds a string of
    ``needles`` (on, needle_id, needle) with the same values of ``on``; ids are unique there.

    Strings are compared as they are: fold case before. Null and empty strings, and null texts, meet nothing. A word that all
    texts share is an anchor only of a string that has no rarer one."""
    asked = needles.filter("needle <> ''").withColumn("kind", _kind("needle"))
    only = sorted(r["kind"] for r in asked.select("kind").distinct().collect())  # seven kinds at most
    if not only:
        none = needles.join(texts.select(*on, "text_id", "body"), on) if on else needles.join(texts, F.lit(False))
        return none.filter("false").select(*on, "needle_id", "text_id", "needle", "body")
    parts = [_anchors(asked.filter(F.col("kind") == k), [*on, "needle_id"], "needle", True, k) for k in only]
    anchors = written(reduce(DataFrame.unionByName, parts), "anchors")
    wanted = anchors.select(*on, "kind", "h").distinct()
    key = [*on, "kind", "h"]
    bodies = texts.filter("body is not null")
    postings = reduce(DataFrame.unionByName, [_anchors(bodies, [*on, "text_id"], "body", False, k) for k in only])
    postings = written(postings.join(wanted, key, "left_semi"), "postings")
    often = postings.groupBy(*key).agg(F.count("*").alias("often"))
    rated = anchors.join(often, key, "left").groupBy(*on, "needle_id")
    rarest = rated.agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "kind", "h")).alias("a"))
    chosen = rarest.filter("a.often > 0").select(*on, "needle_id", "a.kind", "a.h")
    pairs = chosen.join(postings, key).select(*on, "needle_id", "text_id")
    found = pairs.join(needles.select(*on, "needle_id", "needle"), [*on, "needle_id"]).join(texts.select(*on, "text_id", "body"), [*on, "text_id"])
    return found.filter(F.contains("body", F.col("needle"))).select(*on, "needle_id", "text_id", "needle", "body")
