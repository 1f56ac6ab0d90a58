"""Personal data: fixed patterns, and identifiers that bootstrapped contexts point to.

Base spans (e-mail, IP, card, phone) seed the bootstrapping. Every base span and every other identifier-like string is
an instance; the words around it are its lexical patterns (the two words before; the word before and the word after).
Spark scores the graph of patterns and instances in rounds: a pattern's confidence for a kind is the sum of its
instances' confidences over one more than the evidence: what speaks for any kind, and the instances without a kind that
don't have the characters of this one. Unseen instances of a fitting form count neither way. An instance that no seed
covers gets the noisy-or of its reliable patterns, for kinds it has the characters of. After the last round, reliable patterns mark the unseen identifiers at their places, if these have
the characters of that kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; confidence that makes a pattern reliable (with one in the denominator, it needs 4 seeds).
ROUNDS, RELIABLE = 3, 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A run of digits is entered at its first digit only: where that start fails, later ones in the run fail as well.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Identifier-like: a number in groups with four digits or more, or an address whose sign is written out.
_GROUPS = re.compile(r"[0-9()./ -]{4,}")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\(at\)|\[at\])[A-Za-z0-9.-]+")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", at + 1 if m is None else m.end())
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _patterns(text: str, start: int, end: int, words: list[tuple[int, int]]) -> list[str]:
    """Contexts of a place; words: where the text's words lie. A word that the place is part of counts up to the place."""
    k = bisect_left(words, (start,))
    before = [text[a : min(b, start)].lower() for a, b in words[max(0, k - 2) : k]]
    k = max(0, bisect_right(words, (end, len(text))) - 1)
    after = next((text[max(a, end) : b].lower() for a, b in words[k : k + 2] if b > end), None)
    found = []
    if len(before) == 2:
        found.append("<< " + " ".join(before))
    if before and after:
        found.append(f"< {before[-1]} > {after}")
    return found


def _like(text: str) -> list[tuple[int, int]]:
    """Identifier-like places, each whole; of an address and a number that overlap the address stays."""
    out = [m.span() for m in _ADDRESS.finditer(text)]
    ends = [b for _, b in out]
    for m in _GROUPS.finditer(text):
        left = m[0].lstrip(")./ -")
        body = left.rstrip("()./ -")
        a = m.end() - len(left)
        b, k = a + len(body), bisect_right(ends, a)
        if len(body) >= 4 and sum(map(str.isdigit, body)) >= 4 and (k == len(ends) or out[k][0] >= b):
            out.append((a, b))
    return sorted(out)


def _others(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like places that no base span touches."""
    taken = sorted((a, b) for _, a, b in base)
    out, k = [], 0
    for a, b in _like(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            out.append((a, b))
    return out


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SCAN_SQL = (
    f"doc_id long, text_hash long, base {_SPANS}, "
    "found array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>"
)
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([*_SPAN, ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, founds = [], []
        for x in batch.column(2):
            text = x.as_py() or ""
            base = base_spans(text)
            bases.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
            places = [*base, *((None, a, b) for a, b in _others(text, base))]
            words = [m.span() for m in _WORD.finditer(text)] if places else []
            founds.append(
                [{"kind": k, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": _patterns(text, a, b, words)} for k, a, b in places]
            )
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(bases, pa.list_(_SPAN)), pa.array(founds, pa.list_(_FOUND))],
            names=["doc_id", "text_hash", "base", "found"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base spans, and all instances with their patterns. ``text_hash`` tells apart texts
    under one doc_id."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(_scan_batches, _SCAN_SQL)


def reliable_patterns(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are reliable after the last round, each with its best kind."""
    seen = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.instance", F.explode("f.patterns").alias("pattern"))
    seeds = [F.max((F.col("kind") == k).cast("double")).alias(k) for k in KINDS]
    edges = materialize(seen.groupBy("pattern", "instance").agg(*[F.coalesce(s, F.lit(0.0)).alias(k) for s, k in zip(seeds, KINDS, strict=True)]).withColumns({f"fit_{k}": _has_form(F.lit(k), F.col("instance")) for k in KINDS}), "pii-edges")
    known = edges.groupBy("instance").agg(*[F.max(k).alias(k) for k in KINDS])
    best = F.greatest(*KINDS)
    for _ in range(rounds):
        by_pattern = edges.drop(*KINDS).join(known, "instance").groupBy("pattern")
        evidence = {k: F.sum(F.when(best > 0, best).otherwise((~F.col(f"fit_{k}")).cast("double"))) for k in KINDS}
        scored = by_pattern.agg(*[(F.sum(k) / (evidence[k] + 1)).alias(k) for k in KINDS]).filter(best >= RELIABLE)
        scored = materialize(scored, "pii-patterns")
        doubt = [F.sum(F.log1p(-F.least(F.col(f"s_{k}"), F.lit(0.999)))).alias(f"d_{k}") for k in KINDS]
        renamed = scored.select("pattern", *[F.when(F.col(k) >= RELIABLE, F.col(k)).otherwise(0.0).alias(f"s_{k}") for k in KINDS])
        told = edges.join(renamed, "pattern").groupBy("instance").agg(*doubt)
        raised = [F.greatest(F.col(k), F.when((best < 1) & _has_form(F.lit(k), F.col("instance")), 1 - F.exp(f"d_{k}")).otherwise(0.0)).alias(k) for k in KINDS]
        # a seed keeps its own kinds only
        own = edges.groupBy("instance").agg(*[F.max(k).alias(k) for k in KINDS])
        known = materialize(own.join(told, "instance", "left").select("instance", *[F.coalesce(r, F.col(k)).alias(k) for r, k in zip(raised, KINDS, strict=True)]), "pii-instances")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.array_position(F.array(*[F.col(k) for k in KINDS]), best).cast("int"))
    return scored.select("pattern", kind.alias("kind"), best.alias("confidence"))


def _has_form(kind: Column, instance: Column) -> Column:
    digits = F.length(F.regexp_replace(instance, "[^0-9]", ""))
    signed = instance.rlike(r"@|\(at\)|\[at\]")
    return (
        F.when(kind == "email", signed)
        .when(kind == "ip", ~signed & instance.rlike(r"^[0-9]+([./-][0-9]+){3}$"))
        .when(kind == "card", ~signed & digits.between(12, 19))
        .otherwise(~signed & digits.between(7, 15))
    )


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, added): one row per row of ``docs`` (doc_id, text; other columns are ignored).

    ``base`` holds the fixed patterns' spans by kind and start, ``added`` the discovered ones; they never touch base
    spans or one another. A null or empty text has none. Repeated rows give repeated results; a null doc_id is a value
    like others; an empty table gives no rows.
    """
    scanned = materialize(scan(docs), "pii-scan")
    reliable = reliable_patterns(scanned)
    unseen = scanned.select("doc_id", "text_hash", F.explode("found").alias("f")).filter("f.kind is null")
    unseen = unseen.select("doc_id", "text_hash", "f.start", "f.end", "f.instance", F.explode("f.patterns").alias("pattern"))
    told = unseen.join(reliable, "pattern").filter(_has_form(F.col("kind"), F.col("instance")))
    place = told.groupBy("doc_id", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    added = place.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    added = added.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    on = scanned["doc_id"].eqNullSafe(added["d"]) & (scanned["text_hash"] == added["h"])
    empty = F.array().cast(_SPANS)
    return scanned.join(added, on, "left").select("doc_id", "text_hash", "base", F.coalesce("added", empty).alias("added"))


def span_order(spans: Column) -> Column:
    """Spans by kind as listed, then by start."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(F.element_at(rank, s["k"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in span order."""
    return F.array_join(F.transform(span_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets and n_chars brought up to date where it exists.

    Where spans of two kinds overlap, the one that starts first (the longer one at a tie) is replaced and the other's
    rest with it. Only documents with spans are looked up by doc_id and text; the others pass unchanged.
    """
    found = find_pii(docs).select("doc_id", "text_hash", F.concat("base", "added").alias("spans")).filter("size(spans) > 0").distinct()
    found = found.withColumnsRenamed({"doc_id": "_pii_id", "text_hash": "_pii_hash", "spans": "_pii_spans"})
    text = F.col("text").cast("string")
    on = docs["doc_id"].cast("long").eqNullSafe(found["_pii_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["_pii_hash"])
    joined = docs.join(found, on, "left")
    ordered = F.array_sort(F.transform("_pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(end.alias("at"), F.concat(acc["text"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("text"))
        longer = F.struct(F.greatest(acc["at"], end).alias("at"), acc["text"].alias("text"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    def finish(acc: Column) -> Column:
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(acc["text"], rest)

    cleaned = F.when(F.col("_pii_spans").isNull(), F.col("text")).otherwise(F.aggregate(ordered, zero, step, finish))
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(cleaned.alias("text"))
        elif name == "n_chars":
            out.append(F.when(F.col("_pii_spans").isNull(), docs["n_chars"]).otherwise(F.char_length(cleaned)).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(docs[name])
    return joined.select(*out)
