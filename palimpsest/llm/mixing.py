"""Mixing sources to target weights: hash-random order within each source, prefix sums of sizes, a cut at each budget.

Sources take weights in code point order, repeating, and share a budget by them; a source stops at so many epochs of its
own size and what it can't take goes to the others by weight. That level is the largest of (budget - what the sources
before hold at most) / (weights of the others) when sources are ordered by their limit for each weight: as long as a source
is limited, leaving it out raises the others' level, and after the first that isn't the level falls again.

A source's rows come in the order of a hash of their doc_id. Full epochs take every row; in the last one a row gives what
the budget leaves after all rows before it, so the last row taken is cut and a source gives exactly its budget, rounded
down to whole words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.prefix import parts_for, sums_before
from palimpsest.llm.storage import materialize

WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
SEED = "11"


def size_of(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """Hash-random place of a row in its source: the same in every run, and for SQL to repeat."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("-"))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size): what each source is to give. One row per source, the null
    source among them; a source without words has target 0, and so have all if there are no words at all."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    own = materialize(own, "mix-sources")
    n, total = own.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    parts = parts_for(own, n)
    ranked = sums_before(own, parts, [], [F.col("source").asc_nulls_last()], {"rank": "one"}, "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    limit = (F.lit(most) * F.col("source_size")).alias("limit")
    weighed = materialize(ranked.select("source", "source_size", weight.alias("weight"), limit), "mix-weights")
    all_weight = weighed.agg(F.sum("weight")).first()[0] or 0
    by_limit = (F.col("limit") / F.col("weight")).asc()
    filled = sums_before(weighed, parts, [], [by_limit], {"limits": "limit", "weights": "weight"}, "mix-levels")
    level = filled.agg(F.max((F.lit(share * total) - F.col("limits")) / (F.lit(all_weight) - F.col("weights")))).first()[0] or 0.0
    target = F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, carried): one row per row of ``docs`` (doc_id, source, text).

    taken counts the words that the mix takes from the row, repeats included: ``most`` times its size at most. ``carried``
    is a struct of the columns named in ``carry`` and of source; all other columns, of whatever names, are ignored.

    A null text has size 0; a null source is a source of its own, the last one; null doc_ids are ordered like any other
    id. Repeated rows are rows of their own; those of one doc_id are ordered by size, and equal ones can't be told apart, so
    reruns give the same rows. Texts are counted whole, however long. An empty table gives no rows."""
    held = F.struct(*[F.col(c) for c in ("source", *carry)]).alias("carried")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), held)
    rows = materialize(rows.withColumn("key", random_key(F.col("doc_id"))), "mix-rows")
    parts = parts_for(rows, rows.count())
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    order = [F.col("key").asc(), F.col("doc_id").asc(), F.col("size").asc()]
    placed = sums_before(rows, parts, ["source"], order, {"before": "size"}, "mix-order")
    named = targets.select(F.col("source").alias("of"), "source_size", "target")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    found = placed.join(named, placed["source"].eqNullSafe(named["of"])).withColumn("epochs", epochs)
    return found.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "carried")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, epoch, words, text): the mix itself, one row per row and epoch that takes words from it. The text
    of a row that is cut is its first words, joined by blanks; nulls, ties, repeats and empty tables as in ``mix``."""
    found = mix(docs, carry=("text",), **how).filter("taken > 0")
    each = found.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")) - 1)).alias("epoch"))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("carried.text", F.lit(f"({WORD})")), F.lit(1), words.cast("int")), " ")
    text = F.when(words == F.col("size"), F.col("carried.text")).otherwise(cut)
    return each.select("doc_id", "carried.source", F.col("epoch").cast("int").alias("epoch"), words.alias("words"), text.alias("text"))
