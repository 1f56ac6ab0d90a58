"""Similarity join of short strings by their ratio of matching blocks, without comparing all pairs.

The ratio is 2M / (characters of both), M being the characters in matching blocks. M characters in common order mean that at
least M characters are shared as multisets, and that at least 3M - (characters of both) - 1 bigrams are: a gap between two
blocks holds a character that doesn't match, and costs a bigram. So at a ratio of t strings of n and m characters share
at least t(n + m)/2 characters and (1.5t - 1)(n + m) - 1 bigrams. Two sets that share that many members share one among the
first few of each in any common order, and the rarest come first here: each string is dealt by these. Pairs that meet are held
against the bound on characters where they meet, by length and by the parity of their letters, and what is left is compared.
"""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written

_EPS = 1e-9


def _chars(s: Column) -> Column:
    return F.when(F.char_length(s) > 0, F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _bigrams(s: Column) -> Column:
    return F.when(F.char_length(s) > 1, F.transform(F.sequence(F.lit(1), F.char_length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _numbered(parts: Column) -> Column:
    """Members of a multiset as a set: each with its number among equal ones, in front."""
    return F.transform(parts, lambda x, i: F.concat(F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda y: y == x)).cast("string"), F.lit(":"), x))


def _parity(chars: Column) -> Column:
    """64 bits, one for each hash of a character: set if an odd number of characters has it."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(bit(c)))


def least_partner(n: int, ratio: float) -> int:
    """The fewest characters that a string similar to one of n characters has."""
    return math.ceil(n * ratio / (2 - ratio) - _EPS)


def shared_bigrams(n: int, ratio: float) -> int:
    """The fewest bigrams that a string of n characters shares with any that is similar to it."""
    return math.ceil((1.5 * ratio - 1) * (n + least_partner(n, ratio)) - 1 - _EPS)


def longest_short(ratio: float) -> int | None:
    """Up to this length bigrams promise nothing; None if they never do."""
    if 1.5 * ratio - 1 <= _EPS:
        return None
    n = 0
    while shared_bigrams(n + 1, ratio) < 1:
        n += 1
    return n


def _signatures(strings: DataFrame, ratio: float) -> DataFrame:
    """(s, token): the rarest bigrams or characters of each distinct string, as many as the bounds ask for."""
    n, short = F.char_length("s"), longest_short(ratio)
    least = F.ceil(n * F.lit(ratio / (2 - ratio)) - _EPS)
    strings = strings.select("s", _chars(F.col("s")).alias("chars"), _bigrams(F.col("s")).alias("bigrams"))
    letters = _numbered(F.col("chars"))
    by_letters = F.lit(True) if short is None else (n <= short) | (least <= short)
    few_letters = n - F.ceil((n + least) * F.lit(ratio / 2) - _EPS) + 1
    parts = [F.struct(F.lit("c").alias("kind"), few_letters.cast("int").alias("take"), F.when(by_letters, letters).alias("tokens"))]
    if short is not None:
        few_bigrams = n - F.ceil(F.lit(1.5 * ratio - 1) * (n + least) - 1 - _EPS)
        parts.append(F.struct(F.lit("b").alias("kind"), few_bigrams.cast("int").alias("take"), F.when(n > short, _numbered(F.col("bigrams"))).alias("tokens")))
    each = strings.select("s", F.explode(F.array(*parts)).alias("p")).filter("p.tokens is not null")
    each = each.select("s", "p.kind", "p.take", F.explode("p.tokens").alias("t")).withColumn("token", F.concat("kind", "t"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    ranked = each.join(often, "token").groupBy("s", "kind", "take").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("all"))
    rare = ranked.select("s", F.explode(F.transform(F.slice("all", F.lit(1), F.greatest("take", F.lit(1))), lambda x: x["token"])).alias("token"))
    return rare.unionByName(strings.filter("s = ''").select("s", F.lit("empty").alias("token")))


def strings_of(rows: DataFrame, name: str, tokens: DataFrame) -> DataFrame:
    """(name, token, n, odd): the tokens of a column's distinct strings."""
    return rows.select(name).distinct().join(tokens.withColumnRenamed("s", name), name)


def similar_pairs(left: DataFrame, right: DataFrame, group: str, ratio: float) -> DataFrame:
    """(group, a, b, score): pairs of a string of ``left`` (group, a) and one of ``right`` (group, b) of the same group whose
    ratio of matching blocks, a first, is at least ``ratio`` (over 0); every pair once, nulls never.

    Only strings that share a rare token meet, so a group of many strings is spread over its tokens. If all strings together
    meet in fewer ways than there are rows in ``left``, they are compared without the groups, which are joined to the pairs."""
    # written, as several steps read them
    left, right = (written(df.select(group, c).filter(F.col(c).isNotNull()).distinct(), "similar-strings") for df, c in ((left, "a"), (right, "b")))
    strings = left.select(F.col("a").alias("s")).union(right.select(F.col("b").alias("s"))).distinct()
    tokens = written(_signatures(strings, ratio), "similar-tokens")
    spelled = strings.select("s", _chars(F.col("s")).alias("chars")).select("s", F.size("chars").alias("n"), _parity(F.col("chars")).alias("odd"))
    tokens = tokens.join(spelled, "s")
    a, b = strings_of(left, "a", tokens), strings_of(right, "b", tokens)
    # few strings in many groups meet once for all groups, many strings only where a group has both: whichever meets less
    number = F.count("*").cast("double")
    ways = a.groupBy("token").agg(number.alias("x")).join(b.groupBy("token").agg(number.alias("y")), "token").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    apart = ways > left.count()
    if apart:
        a, b = left.join(a, "a"), right.join(b, "b")
    a = a.select("token", "a", *([group] if apart else []), F.col("n").alias("n1"), F.col("odd").alias("odd1"))
    b = b.select("token", "b", *([group] if apart else []), F.col("n").alias("n2"), F.col("odd").alias("odd2"))
    both = F.col("n1") + F.col("n2")
    need = F.ceil(both * F.lit(ratio / 2) - _EPS)
    # bits that differ are at most the characters that only one of the strings has
    fits = (F.least("n1", "n2") >= need) & (F.bit_count(F.col("odd1").bitwiseXOR(F.col("odd2"))) <= both - 2 * need)
    on = [group, "token"] if apart else ["token"]
    met = written(a.join(b, on).filter(fits).select(*on[:-1], "a", "b").distinct(), "similar-met")
    need = F.ceil((F.char_length("a") + F.char_length("b")) * F.lit(ratio / 2) - _EPS)
    pairs = met.select("a", "b").distinct()
    spelled = pairs.select("a", "b", need.alias("need"), _chars(F.col("a")).alias("x"), _chars(F.col("b")).alias("y"))
    close = spelled.filter(F.size(F.array_intersect(_numbered(F.col("x")), _numbered(F.col("y")))) >= F.col("need")).select("a", "b")

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    compared = close.withColumn("score", score("a", "b")).filter(F.col("score") >= ratio)
    if apart:
        return met.join(compared, ["a", "b"]).select(group, "a", "b", "score")
    return left.join(written(compared, "similar-found"), "a").join(right, [group, "b"]).select(group, "a", "b", "score")
