"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only.

Listed URLs (blocked exactly, in canonical form) are written once as distinct keys. The Bloom filter has 64-bit blocks, as
many as the number of keys asks for up to MOST_BLOCKS, so every task may hold it; a key sets BITS_PER_KEY bits of one
block. A page whose canonical URL isn't in the filter is done; only possible hits meet the exact list, in a hash join that
removes the false ones. Beyond MOST_BLOCKS the filter passes more, and the join still decides.

Rules (host and path prefix, for a host and its subdomains) are written in the code, so they are looked up row by row in a
map literal: nothing is moved for them, however many pages share a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import materialize

# The rules as (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bits of the filter for each key and bits that a key sets; least and most blocks of 64 bits (4 MB).
BITS_FOR_KEY, BITS_PER_KEY, LEAST_BLOCKS, MOST_BLOCKS = 16, 4, 1 << 8, 1 << 19


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    # (?s): a line feed in a URL is a character like others
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(host: Column, path: Column) -> Column:
    """The listed form of a URL: host without a leading www., path without trailing slashes; scheme, query and fragment
    play no part. Null without a host."""
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", F.concat(bare, F.rtrim(path, F.lit("/"))))


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """(block number, the key's bits in it)."""
    h = F.xxhash64(key)
    bits = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        place = F.shiftrightunsigned(h, 40 - 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return F.pmod(h, F.lit(blocks)), bits


def blocks_for(n: int) -> int:
    """Blocks of the filter for so many keys."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (n * BITS_FOR_KEY // 64).bit_length()))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, word): the 64 bits of every block that isn't empty; never more than ``blocks`` rows of 16 bytes."""
    block, bits = _bits(F.col("key"), blocks)
    return keys.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word"))


def listed_keys(listed: DataFrame) -> DataFrame:
    """(key): the distinct canonical forms of the column ``url``."""
    host, path = host_and_path(F.col("url"))
    urls = listed.select(F.col("url").cast("string").alias("url")).select(canonical(host, path).alias("key"))
    return urls.filter("key is not null").distinct()


def best_rule(host: Column, path: Column, rules) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits; null without one. Of rules with one host and path the
    first in ``rules`` holds, and of rules of one length the one whose host is longer."""
    table: dict[str, tuple[int, str, str]] = {}
    for verdict, rule_host, rule_path in rules:
        table.setdefault(f"{rule_host}\n{rule_path}", (len(rule_host) + len(rule_path), rule_host + rule_path, verdict))
    if not table:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    known = F.create_map(*[c for k, (size, rule, verdict) in table.items() for c in (F.lit(k), F.struct(F.lit(size).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))])
    # the host's last labels, as many as rules have, the longest first; substring_index gives the whole host if it has fewer
    most = max(rule_host.count(".") + 1 for _, rule_host, _ in rules)
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in range(most, 0, -1)]))
    lengths = sorted({len(p) for _, _, p in rules})
    heads = F.array_compact(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    found = F.array_compact(F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.try_element_at(known, F.concat(s, F.lit("\n"), p))))))
    return F.when(host != "", F.reduce(found, F.try_element_at(found, F.lit(1)), lambda a, b: F.when(b["size"] > a["size"], b).otherwise(a)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): one row per row of ``pages`` (page_id, url; others are ignored).

    ``listed`` has one column ``url`` of blocked URLs, compared in canonical form. The longest rule that fits decides;
    without a rule a listed URL is blocked, else ``default`` holds. A null url or one without :// has an empty host and
    path, fits nothing and isn't listed. Null, repeated and hostless listed URLs do no harm; an empty list or an empty
    table is fine. Of rules with one host and path the first holds, of fitting rules of one length the one with the longer
    host. URLs are judged whole, however long; repeated rows give repeated results.
    """
    host, path = host_and_path(F.col("url"))
    at = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    at = at.select("page_id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("best"), canonical(F.col("host"), F.col("path")).alias("key"))
    keys = materialize(listed_keys(listed), "listed")
    blocks = blocks_for(keys.count())
    block, bits = _bits(F.col("key"), blocks)
    # the filter's size is bounded, so every task may hold it
    tested = at.withColumn("block", block).join(F.broadcast(bloom(keys, blocks)), "block", "left")
    possible = F.coalesce(F.col("key").isNotNull() & (F.col("word").bitwiseAND(bits) == bits), F.lit(False))
    tested = tested.select("page_id", "host", "path", "best", "key", possible.alias("possible"))
    exact = keys.select(F.col("key").alias("listed_key")).hint("shuffle_hash")
    hits = tested.filter("possible").join(exact, F.col("key") == F.col("listed_key"), "left")
    judged = tested.filter("not possible").withColumn("listed", F.lit(False)).drop("possible").unionByName(
        hits.withColumn("listed", F.col("listed_key").isNotNull()).drop("possible", "listed_key")
    )
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), F.lit("block")), F.lit(default))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed")
