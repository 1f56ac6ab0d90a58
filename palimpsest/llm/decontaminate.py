"""Benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

1. Words are maximal runs of letters and digits, lower-cased; shingles are five words (all words, if an item has fewer).
2. A window of a document has as many words as an item. Windows that share no shingle with an item have similarity 0, so
   windows are taken at every start whose window holds a shingle of the item, if the shingles it shares have the weight
   that the similarity needs at least.
3. Equal windows are one class. Window classes and items get 64-bit SimHashes, weighted by shingle weight.
4. Multi-index: RADIUS + 1 blocks of bits; two fingerprints within RADIUS agree in one block at least (pigeonhole), so
   equal blocks of windows and items of one size give all candidates, of which those within RADIUS in all 64 bits stay.
   Which item a window was taken for plays no part in it.
5. Each candidate is verified: weighted shingle similarity, twice the common weight over the sum of both weights, repeats
   counted, must be 0.8 or more. A shingle's weight is the number of its letters and digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: Bits that may differ. Weighted vectors at the least similarity allowed lie at an angle of about acos(0.8), for which
#: 13 of 64 bits are expected to differ; the radius is over three standard deviations beyond that.
RADIUS = 23
#: Up to so many benchmark shingles (a few MB) are sent to every task and the words around a hit come along; beyond, only
#: places and hashes are shuffled to the shingles, and the words are fetched for the hits. The rows are the same.
BROADCAST_SHINGLES = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(tokens: Column, size: Column) -> Column:
    """Every ``size`` words with a blank between, in order."""
    count = F.size(tokens) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, size), " "))).otherwise(
        F.array().cast("array<string>")
    )


def _places(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """(keep, p, h): the hash of every ``size`` words by the place of the first one."""
    at = rows.filter(F.size("tokens") >= size).select("tokens", *[k for k in keep if k != "tokens"], F.explode(F.sequence(F.lit(0), F.size("tokens") - size)).alias("p"))
    return at.select(*keep, "p", F.xxhash64(*[F.col("tokens")[F.col("p") + i] for i in range(size)]).alias("h"))


def _weight(shingle: Column) -> Column:
    return F.char_length(F.replace(shingle, F.lit(" ")))


def _bags(rows: DataFrame, key: str) -> DataFrame:
    """(key, shingle, n, w): counts and weights of each key's shingles."""
    each = rows.select(key, F.explode("shingles").alias("shingle"))
    return each.groupBy(key, "shingle").agg(F.count("*").alias("n")).withColumn("w", _weight(F.col("shingle")))


def _simhash(bags: DataFrame, key: str) -> DataFrame:
    """(key, fp, weight): bit b is set if the weight of shingles with bit b set in their hash is over half."""
    h = bags.select(key, (F.col("n") * F.col("w")).alias("nw"), F.xxhash64("shingle").alias("h"))
    sums = [F.sum(F.when(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1, F.col("nw")).otherwise(0)).alias(f"b{b}") for b in range(64)]
    total = h.groupBy(key).agg(F.sum("nw").alias("weight"), *sums)
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return total.select(key, "weight", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"))


def _blocks() -> list[tuple[int, int]]:
    """(shift, width) of RADIUS + 1 blocks that cover the 64 bits."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _block_keys() -> Column:
    return F.array(
        *[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("bits")) for i, (s, w) in enumerate(_blocks())]
    )


def _with_tokens(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long"), words(F.col("text").cast("string")).alias("tokens")).filter("size(tokens) > 0")
    return items.select("item_id", "tokens", F.least(F.lit(SHINGLE), F.size("tokens")).alias("size"), F.size("tokens").alias("n_words")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, n_windows): items whose passage a document holds, with the best window's similarity
    and the number of matching windows. Documents without one have no row.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Null and wordless texts
    match nothing. Items with fewer words than a shingle are one shingle. A document shorter than an item is one window.
    Repeated rows and equal texts count once per doc_id; empty tables give no rows.
    """
    items = materialize(_with_tokens(benchmark), "items")
    # equal item texts are one class; every item of a class shares its matches
    classes = items.select("tokens", "size", "n_words").distinct()
    classes = classes.select(F.xxhash64("tokens").alias("item"), "tokens", "size", "n_words").dropDuplicates(["item"])
    classes = materialize(classes.withColumn("shingles", _shingles(F.col("tokens"), F.col("size"))), "item-classes")
    sizes = sorted(r["size"] for r in classes.select("size").distinct().collect())  # at most five values
    if not sizes:
        return _empty(docs)
    small = classes.agg(F.sum(F.size("shingles"))).first()[0] <= BROADCAST_SHINGLES

    tokenized = docs.select(F.col("doc_id").cast("long"), words(F.col("text").cast("string")).alias("tokens"))
    tokenized = tokenized.withColumn("text", F.xxhash64("tokens"))
    whole = tokenized.select(F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"), "tokens").dropDuplicates(["_doc_id", "_text"])
    met = []
    for size in sizes:
        postings = _places(classes.filter(F.col("size") == size), size, "item", "n_words", "tokens")
        shingle = F.array_join(F.slice("tokens", F.col("p") + 1, size), " ")
        postings = postings.select("h", "item", "n_words", _weight(shingle).alias("w")).dropDuplicates(["h", "item"])
        if small:
            found = _places(tokenized, size, "doc_id", "text", "tokens").join(F.broadcast(postings), "h")
        else:
            found = _places(tokenized, size, "doc_id", "text").join(postings, "h").dropDuplicates(["doc_id", "text", "item", "p"])
            same = found["doc_id"].eqNullSafe(whole["_doc_id"]) & (found["text"] == whole["_text"])
            found = found.join(whole, same).drop("_doc_id", "_text")
        first = F.greatest(F.lit(0), F.col("p") - F.col("n_words") + size)
        last = F.least(F.col("p"), F.greatest(F.lit(0), F.size("tokens") - F.col("n_words")))
        around = F.slice("tokens", first + 1, last - first + F.col("n_words"))
        met.append(
            found.select(
                "doc_id", "text", "item", "n_words", F.lit(size).alias("size"), "p", "w",
                first.alias("first"), last.alias("last"), around.alias("around"),
            )
        )
    place = ["doc_id", "text", "item", "p"]
    hits = materialize(reduce(DataFrame.unionByName, met).dropDuplicates(place), "hits")
    # 2c / (c + item's weight) is the most that a window can reach whose shared shingles weigh c
    least = classes.select("item", (F.aggregate("shingles", F.lit(0), lambda x, y: x + _weight(y)) * similarity / (2 - similarity)).alias("least"))
    held = hits.select("doc_id", "text", "item", "p", "w", F.explode(F.sequence("first", "last")).alias("start"))
    held = held.groupBy("doc_id", "text", "item", "start").agg(F.sum("w").alias("w"), F.min("p").alias("p"))
    held = held.join(least, "item").filter(F.col("w") >= F.col("least") - 1e-6)
    held = held.select(*[F.col(c).alias(f"_{c}") for c in place], "start")
    on = reduce(Column.__and__, [hits[c].eqNullSafe(held[f"_{c}"]) for c in place])
    window = F.slice("around", F.col("start") - F.col("first") + 1, F.col("n_words"))
    windows = hits.join(held, on).select("doc_id", "start", "n_words", "size", window.alias("window"))
    # one row per document, place and window; then equal windows of one item size are one class
    windows = windows.withColumn("win", F.xxhash64("window", "size", "n_words")).dropDuplicates(["doc_id", "start", "win"])
    windows = materialize(windows, "windows")
    texts = windows.select("win", "size", "window").dropDuplicates(["win"])
    texts = texts.select("win", _shingles(F.col("window"), F.least(F.col("size"), F.size("window"))).alias("shingles"))
    window_bags = materialize(_bags(texts, "win"), "window-bags")
    item_bags = materialize(_bags(classes, "item"), "item-bags")

    window_prints = _simhash(window_bags, "win").select("win", F.col("weight").alias("window_weight"), F.col("fp"))
    item_prints = _simhash(item_bags, "item").select("item", F.col("weight").alias("item_weight"), F.col("fp"))
    item_prints = item_prints.join(classes.select("item", "n_words"), "item")
    sized = windows.select("win", "n_words").dropDuplicates(["win"]).join(window_prints, "win")
    left = sized.select("win", "n_words", "window_weight", "fp", F.explode(_block_keys()).alias("k"))
    right = item_prints.select("item", "n_words", "item_weight", F.col("fp").alias("item_fp"), F.explode(_block_keys()).alias("k"))
    near = left.join(right, ["n_words", "k"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("win", "item", "window_weight", "item_weight").distinct()

    a = window_bags.select("win", "shingle", F.col("n").alias("n1"), "w")
    b = item_bags.select("item", "shingle", F.col("n").alias("n2"))
    common = near.join(a, "win").join(b, ["item", "shingle"]).groupBy("win", "item", "window_weight", "item_weight")
    common = common.agg(F.sum(F.least("n1", "n2") * F.col("w")).alias("common"))
    score = 2 * F.col("common") / (F.col("window_weight") + F.col("item_weight"))
    verified = common.withColumn("similarity", score).filter(F.col("similarity") >= similarity).select("win", "item", "similarity")
    verified = materialize(verified, "verified")

    ids = items.select("item_id", F.xxhash64("tokens").alias("item"))
    hits = windows.select("doc_id", "start", "win").join(verified, "win").join(ids, "item")
    return hits.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.countDistinct("start").alias("n_windows"))


def _empty(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, n_windows long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept. Rows with a null doc_id go only if a row with
    a null doc_id holds one."""
    bad = materialize(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]), "left_anti")
