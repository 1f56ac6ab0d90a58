"""Near-duplicate texts by SimHash: Jaccard similarity of 0.8 or more over five-word shingles, for the corpus pipeline.

A text's fingerprint is a ring of WORDS SimHash words of 64 bits over its distinct shingles, each word with hashes of its
own: a bit is set if over half the hashes have it. At 0.8 at most 15 % of the bits are expected to differ, ten of 64, so no
radius over a single word selects anything. Instead a word has SEGMENTS segments, and two texts are candidates where they
agree in a segment and the chain goes on: the next word on the ring differs in at most RADIUS bits. A segment agrees with a
probability of 0.072 at 0.8, the next word is within the radius with 0.99; over 128 segments a pair at 0.8 is missed with a
probability of about 1e-4, at 0.85 of 1e-6. Bits of the smallest sets differ more often (of 4 and 5 shingles 3 of 16), so sets up
to 8 have two rings. Sets below 4 are never similar to others; equal sets are one class. Candidates are verified on the whole shingle sets, so
nothing below 0.8 is linked.

A bucket, the texts that agree in a segment, is screened for candidates in arrays, by size. One that has any emits a pair for each
member that resembles a leader, and names each member that resembles none but an absorbed text. Once the pairs are verified
and joined to components, only pairs of different components are left to compare: a pair that wasn't tried has a text that
another leader absorbed, so the texts named include both. These are held against a bound that needs no sets: a text's parity
sketch has a bit for each of PARITY hash values, set if an odd number of its shingles has that value. Bits that differ between
two sketches are at most the shingles that only one of the texts has, and those are at most a ninth of both counts at a
similarity of 0.8. So no link is lost, and pairs of short texts below 0.8 are hardly ever emitted. Every pair of different
components that the bounds allow is emitted, in the first of the segments that makes it a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.simhash import SEED
from palimpsest.llm.storage import materialize, small_batches
from palimpsest.llm.words import blank_words

SHINGLE, WORDS, SEGMENTS, WIDTH = 5, 32, 4, 16
#: Bits of the next word that may differ. At 0.8 ten are expected, between texts that share nothing 32.
RADIUS = 16
#: Distinct shingles below which no other set reaches 0.8, and up to which a text has two rings.
LEAST, SHORT = 4, 8
#: Shingles whose bits are counted at once, in bytes.
BLOCK = 255
#: Bits of a parity sketch.
PARITY = 1024
#: Bits of a row's key below its segment's number and value; they hold the count of shingles.
SIZE_BITS = 38
#: Rows of whole buckets that are screened at once.
SCREENED = 1 << 16
_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 64, 2 * WORDS, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, 2 * WORDS, np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles (all words, if it has fewer); none without words."""
    words = blank_words(text)
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    grams = {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} if words else ()
    return np.unique(np.array([digest(g, SEED) for g in grams], np.uint64))


def simhashes(hashes: np.ndarray) -> np.ndarray:
    """The SimHash words of a shingle set: none below LEAST shingles, two rings up to SHORT."""
    n = len(hashes)
    count = 0 if n < LEAST else WORDS if n > SHORT else 2 * WORDS
    ones = np.zeros(64 * count, np.int64)
    for k in range(0, n if count else 0, BLOCK):
        mixed = (hashes[k : k + BLOCK, None] ^ _FLIP[:count]) * _ODD[:count]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD[0]
        mixed ^= mixed >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), 0, np.uint8)
    return np.packbits(ones * 2 > n).view("<u8")


def parity(hashes: np.ndarray) -> bytes:
    return np.packbits((np.bincount(hashes & np.uint64(PARITY - 1), minlength=PARITY) & 1).astype(bool)).tobytes()


def _class(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, n, words = [], [], []
        for text in batch.column(1):
            hashes = shingle_set(text.as_py())
            cls.append(_class(hashes))
            n.append(len(hashes))
            words.append(simhashes(hashes).view(np.int64))
        yield pa.record_batch(
            [batch.column(0), _signed(cls), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["doc_id", "cls", "n", "words"]
        )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(0)]
        yield pa.record_batch(
            [
                _signed([_class(s) for s in sets]),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([parity(s) for s in sets], pa.binary()),
            ],
            names=["cls", "shingles", "odd"],
        )


def _near(n: np.ndarray, word: np.ndarray, others: np.ndarray, me: int) -> np.ndarray:
    fits = 5 * np.minimum(n[others], n[me]) >= 4 * np.maximum(n[others], n[me])
    return fits & (np.bitwise_count(word[others] ^ word[me]) <= RADIUS)


def _screened(bucket: np.ndarray, n: np.ndarray, word: np.ndarray, group: np.ndarray | None) -> list[tuple[int, int]]:
    """Bounds of the buckets that hold a candidate pair (of different groups). Rows are sorted by bucket and n."""
    lo = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    number = np.repeat(np.arange(len(lo)), np.diff(np.r_[lo, len(bucket)]))
    hit, at, step = np.zeros(len(lo), bool), np.arange(len(bucket)), 0
    if group is not None:  # buckets of one group have nothing to compare
        at = at[(np.minimum.reduceat(group, lo) != np.maximum.reduceat(group, lo))[number]]
    while len(at):
        step += 1
        at = at[at < len(bucket) - step]
        with_ = at + step
        fits = (number[at] == number[with_]) & (4 * n[with_] <= 5 * n[at])
        at, with_ = at[fits], with_[fits]
        near = np.bitwise_count(word[at] ^ word[with_]) <= RADIUS
        if group is not None:
            near &= group[at] != group[with_]
        hit[number[at[near]]] = True
        at = at[~hit[number[at]]]
    return list(zip(lo[hit].tolist(), np.r_[lo, len(bucket)][1:][hit].tolist(), strict=True))


def _leaders(cls: np.ndarray, n: np.ndarray, word: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs of one bucket that may be similar: each member with its leader. A leader without members is paired with itself
    if it may be similar to a text that another leader absorbed, so that the next round compares them."""
    left, absorbed, us, vs = np.arange(len(cls)), np.zeros(0, np.int64), [], []
    while len(left):
        me, left = left[0], left[1:]
        near = _near(n, word, left, me)
        found = left[near] if near.any() else np.array([me]) if _near(n, word, absorbed, me).any() else left[:0]
        us.append(np.repeat(cls[me], len(found)))
        vs.append(cls[found])
        absorbed, left = np.r_[absorbed, left[near]], left[~near]
    return us, vs


def _across(
    segment: int, cls: np.ndarray, n: np.ndarray, word: np.ndarray, group: np.ndarray, odd: np.ndarray, words: np.ndarray
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs of different groups in a bucket of ``segment`` that may be similar and are no candidates of an earlier segment."""
    us, vs = [], []
    for me in range(len(cls) - 1):
        found = np.arange(me + 1, len(cls))
        found = found[_near(n, word, found, me) & (group[found] != group[me])]
        found = found[9 * np.bitwise_count(odd[found] ^ odd[me]).sum(1, dtype=np.int64) <= n[found] + n[me]]
        differ = words[found] ^ words[me]
        agree = differ.view("<u2").reshape(len(found), WORDS, SEGMENTS)[:, :, ::-1] == 0
        agree &= (np.bitwise_count(np.roll(differ, -1, 1)) <= RADIUS)[:, :, None]
        found = found[~agree.reshape(len(found), WORDS * SEGMENTS)[:, :segment].any(1)]
        us.append(np.repeat(cls[me], len(found)))
        vs.append(cls[found])
    return us, vs


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cls, word and, after the first round, group, odd, words) arrive sorted by key, which holds segment, value and
    n; they are held until enough buckets are whole."""

    def pairs(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, cls, word, *more = cols
        bucket, n = key >> SIZE_BITS, key & ((1 << SIZE_BITS) - 1)
        none = np.zeros(0, np.int64)
        us, vs = [none], [none]
        for a, b in _screened(bucket, n, word, more[0] if more else None):
            if more:
                u, v = _across(int(bucket[a]) >> WIDTH, cls[a:b], n[a:b], word[a:b], *(c[a:b] for c in more))
            else:
                u, v = _leaders(cls[a:b], n[a:b], word[a:b])
            us += u
            vs += v
        return pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    held: list[list[np.ndarray]] = []
    rows, least = 0, SCREENED
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [np.asarray(c) for c in batch.columns[:4]]
        if len(batch.columns) > 4:
            new.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(batch.num_rows, -1))
            new.append(np.asarray(batch.column(5).flatten()).reshape(batch.num_rows, WORDS).view(np.uint64))
        new[2] = new[2].view(np.uint64)
        held.append(new)
        rows += batch.num_rows
        if rows < least:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = int(np.searchsorted(cols[0] >> SIZE_BITS, cols[0][-1] >> SIZE_BITS))
        if last:
            yield pairs([c[:last] for c in cols])
        held, rows = [[c[last:] for c in cols]], rows - last
        least = max(SCREENED, 2 * rows)
    if held:
        yield pairs([np.concatenate(x) for x in zip(*held, strict=True)])


def _bucket_pairs(members: DataFrame, *more: str) -> DataFrame:
    place = F.posexplode("words").alias("t", "w")
    ring = F.pmod(F.col("t") + 1, F.lit(WORDS)) + F.col("t") - F.pmod("t", F.lit(WORDS))
    dealt = members.select("cls", "n", "words", place, *more).withColumn("word", F.get("words", ring.cast("int")))

    def key(segment: int):
        value = F.shiftrightunsigned("w", 64 - WIDTH * (segment + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1))
        number = F.shiftleft((F.col("t") * SEGMENTS + segment).cast("long"), WIDTH).bitwiseOR(value)
        return F.shiftleft(number, SIZE_BITS).bitwiseOR(F.col("n"))

    if more:
        more = (*more, F.slice("words", 1, WORDS).alias("words"))
    dealt = dealt.select(F.explode(F.array(*map(key, range(SEGMENTS)))).alias("key"), "cls", "word", *more)
    parts = max(2, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.repartition(parts, F.shiftrightunsigned("key", SIZE_BITS)).sortWithinPartitions("key", "cls")
    return rows.mapInArrow(_bucket_batches, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("left"))
    b = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    # 9 * common >= 4 * (sum of sizes) is common / union >= 0.8
    return pairs.filter("u <> v").join(b, "v").join(a, "u").filter(9 * common >= 4 * (F.size("left") + F.size("right"))).select("u", "v")


def near_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): one row per row of ``docs`` (doc_id, text; other columns are ignored).

    Texts link at a Jaccard similarity of 0.8 or more; component_id is the smallest doc_id reachable. Null and blank
    texts are one class. Texts are compared whole, however long; an empty table gives no rows. Repeated rows and null
    doc_ids are treated as in ``simhash.near_duplicates``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = materialize(rows.mapInArrow(_print_batches, "doc_id long, cls long, n long, words array<long>"), "near-prints")
    own = ["n", "words"]
    classes = materialize(prints.groupBy("cls").agg(F.min("doc_id").alias("first"), *[F.any_value(c).alias(c) for c in own]), "near-classes")

    tried = materialize(_bucket_pairs(classes), "near-pairs")
    names = tried.select(F.col("u").alias("cls")).union(tried.select(F.col("v").alias("cls"))).distinct()
    members = materialize(classes.join(names.hint("merge"), "cls"), "near-members")
    # one text of each class that meets another; merged at every size, as the ids grow with the documents
    wanted = members.select(F.col("first").alias("id")).distinct().hint("merge")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_set_batches, "cls long, shingles array<long>, odd binary").dropDuplicates(["cls"])
    sets = materialize(sets, "near-sets")

    links = materialize(_verified(tried, sets), "near-links")
    found = components(links)
    groups = found.select(F.col("node").alias("cls"), F.col("component").alias("found"))
    apart = members.join(groups, "cls", "left").withColumn("group", F.coalesce("found", "cls"))
    apart = apart.join(sets.select("cls", "odd").hint("merge"), "cls")
    again = _bucket_pairs(apart, "group", "odd").join(tried, ["u", "v"], "left_anti")
    links = materialize(_verified(again, sets), "near-links")
    # the components found so far stand for the links that made them
    found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))

    linked = found.join(classes.select(F.col("cls").alias("node"), "first"), "node")
    lowest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = linked.join(lowest, "component").select(F.col("node").alias("cls"), "component_id")
    named = classes.select("cls", "first").join(by_class, "cls", "left").select("cls", F.coalesce("component_id", "first").alias("component_id"))
    named = materialize(named, "near-named")
    return prints.select("doc_id", "cls").join(named, "cls").select("doc_id", "component_id")
