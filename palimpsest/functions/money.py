"""Amounts and counts in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.constants import COUNT_NOUNS, CURRENCIES

# What an amount and a count look like.
AMOUNT = r"([$€£])\s*(\d+(?:,\d{3})*(?:\.\d{1,2})?)"
USD = r"\$\s*(\d+(?:,\d{3})*(?:\.\d{1,2})?)"
COUNT = r"(?i)(?<![\d-])\b(\d+)\s+(?:(?:[A-Za-z]+)\s+)?(?:" + "|".join(COUNT_NOUNS) + r")\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def amount(text: Column | str) -> Column:
    """struct(amount decimal, currency) of the first amount; both null if there is none."""
    digits = F.nullif(F.regexp_extract(_col(text), AMOUNT, 2), F.lit(""))
    symbol = F.regexp_extract(_col(text), AMOUNT, 1)
    names = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    return F.struct(F.replace(digits, F.lit(",")).cast("decimal(18,2)").alias("amount"), F.try_element_at(names, symbol).alias("currency"))


def usd_amounts(text: Column | str) -> Column:
    """Every dollar amount of the text, in order, as decimals: 1,000.00 and 1000 are equal."""
    found = F.regexp_extract_all(_col(text), F.lit(USD), 1)
    return F.transform(found, lambda x: F.replace(x, F.lit(",")).cast("decimal(18,2)"))


def amount_near(text: Column | str, mention: Column | str) -> Column:
    """The amount that starts nearest to the first mention (ties to the earlier); the first amount without a mention."""
    text, mention = _col(text), _col(mention)
    at = F.instr(F.lower(text), F.lower(mention))
    found = F.regexp_extract_all(text, F.lit(f"({AMOUNT})"), 1)
    zero = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<far:int,at:int,text:string>>").alias("seen"))

    def step(acc: Column, piece: Column) -> Column:
        start = F.locate_in(piece, text, acc["from"]) if hasattr(F, "locate_in") else F.call_function("locate", piece, text, acc["from"])
        seen = F.struct(F.abs(start - at).alias("far"), start.alias("at"), piece.alias("text"))
        return F.struct((start + F.length(piece)).alias("from"), F.concat(acc["seen"], F.array(seen)).alias("seen"))

    nearest = F.array_min(F.aggregate(found, zero, step, lambda acc: acc["seen"]))
    return amount(F.when(at > 0, nearest["text"]).otherwise(text))


def count(text: Column | str) -> Column:
    """The number before a counted noun, not part of a range; null if there is none."""
    return F.nullif(F.regexp_extract(_col(text), COUNT, 1), F.lit("")).cast("long")


def plain_number(value: Column | str) -> Column:
    """A decimal without trailing zeros: 1.50 is 1.5, 1000.00 is 1000."""
    text = _col(value).cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
