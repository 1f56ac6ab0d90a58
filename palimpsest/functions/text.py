"""Text expressions: canonical forms, keys, tokens, rendering, JSON. Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.constants import RELATIONS, STOP_WORDS


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_text(text: Column | str, unicode_forms: bool = False) -> Column:
    """Trimmed, lower-case, white space collapsed. NFKC has no built-in: ask for it with ``unicode_forms`` (a pandas
    UDF); for ASCII text both give the same."""
    text = _nfkc(_col(text)) if unicode_forms else _col(text)
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def canonical_key(key: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Key identity: lower-case, runs of blanks, dots, underscores and hyphens are one dot, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(key))), r"(?U)[\s._-]+", "."), r"^\.+|\.+$", "")
    for alias, name in (aliases or {}).items():
        out = F.when(out == alias, F.lit(name)).otherwise(out)
    return out


def token_count(text: Column | str) -> Column:
    """White-space tokens; 0 for null and blank text."""
    clean = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")


def token_estimate(chars: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(_col(chars) / 4)).cast("long")


def rendered(role: Column | str, content: Column | str) -> Column:
    """``Role: content``."""
    role = _col(role)
    return F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substring(role, 2, 1 << 30)), F.lit(": "), _col(content))


def session_header(index: Column | str, date: Column | str) -> Column:
    return F.concat(F.lit("## Session "), (_col(index) + 1).cast("string"), F.lit(" — "), _col(date))


def evidence_label(number: Column | str, role: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("[e"), _col(number).cast("string"), F.lit("]["), _col(role), F.lit("] "), _col(content))


def short_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, 24)


def terms(text: Column | str) -> Column:
    """Distinct runs of a-z and 0-9 of the canonical text."""
    return F.array_distinct(F.regexp_extract_all(canonical_text(F.coalesce(_col(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def singular(term: Column) -> Column:
    long = F.length(term) > 4
    return (
        F.when(long & term.endswith("ies"), F.concat(F.expr("''"), F.substring(term, F.lit(1), F.length(term) - 3), F.lit("y")))
        .when(long & term.endswith("s") & ~term.endswith("ies"), F.substring(term, F.lit(1), F.length(term) - 1))
        .otherwise(term)
    )


def query_terms(question: Column | str) -> Column:
    """Terms of a question that may match facts: four letters or more, no stop words, plural ends dropped."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(terms(question), lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t))
    return F.array_distinct(F.transform(kept, singular))


def predicate(relation: Column | str) -> Column:
    """The canonical predicate of a surface relation; null for an unknown one."""
    pairs = [F.lit(x) for name, surfaces in RELATIONS.items() for s in surfaces for x in (s, name)]
    return F.element_at(F.create_map(*pairs), canonical_text(relation))


def json_object(text: Column | str, lenient: bool = True) -> Column:
    """A VARIANT object from a model's answer without its code fence; null if it holds none.

    Lenient: else the part from the first { to the last }."""
    text = F.trim(_col(text))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    parsed = F.try_parse_json(bare)
    if lenient:
        parsed = F.coalesce(parsed, F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def parse_judgment(text: Column | str) -> Column:
    """yes or no from a judge's answer: the JSON field, else the first such word, else null."""
    named = F.lower(F.get_json_object(_col(text), "$.judgment"))
    word = F.nullif(F.lower(F.regexp_extract(_col(text), r"(?i)\b(yes|no)\b", 1)), F.lit(""))
    return F.coalesce(F.when(named.isin("yes", "no"), named), word)


def event_coordinates(event_id: Column | str) -> Column:
    """struct(batch, item) of ``b<batch>-i<item>``; null if it isn't of that form."""
    event_id = _col(event_id)
    form = r"^b(\d+)-i(\d+)$"
    found = F.struct(F.regexp_extract(event_id, form, 1).alias("batch"), F.regexp_extract(event_id, form, 2).alias("item"))
    return F.when(event_id.rlike(form), found).cast("struct<batch:bigint,item:bigint>")
