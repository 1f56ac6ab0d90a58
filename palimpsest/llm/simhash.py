"""SimHash near-duplicates: fingerprints, pigeonring candidate chains, exact Hamming check, components.

The 64 bits are four ring segments of 16. If two fingerprints differ in at most 3 bits, then by the pigeonring
principle some segment starts a chain whose differences over 1, 2, 3 segments stay within l * 3 / 4 rounded down, that
is 0, 1 and 2. So fingerprints are dealt by (segment number, chain of two segments): a segment's value and the next one's,
as it is and with each bit off, which keeps buckets small also where many fingerprints share a segment. Inside a bucket the
chain of three prunes before the full Hamming check. ``chain_key=1`` deals by one segment only, for comparison.

A bucket never emits its pairs: a search from each unvisited fingerprint absorbs all fingerprints within reach and
links each one to the one that found it, which gives a spanning forest of the bucket's link graph. Equal fingerprints
are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.storage import materialize, small_batches
from palimpsest.llm.words import blank_words

SEED, RADIUS, SEGMENTS, WIDTH = 42, 3, 4, 16
#: Shingle hashes whose bits are counted at once.
BLOCK = 16_384
#: Segments that a bucket fixes; the links found are the same.
CHAIN_KEY = 2


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 for a text without words."""
    words = blank_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        part = np.array(hashes[k : k + BLOCK], np.uint64)
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    # unpackbits shows each byte's high bit first and the bytes low first; packing the same way undoes both
    return int(np.packbits(ones * 2 > n).view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprint_batches, "doc_id long, fp long"
    )


def _rolled(fps: np.ndarray, segment: int) -> np.ndarray:
    """The ring turned so that ``segment`` comes first (in the high bits)."""
    k = np.uint64(segment * WIDTH)
    return fps if not segment else (fps << k) | (fps >> (np.uint64(64) - k))


def _forest(fps: np.ndarray, exact: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that span the bucket's link graph. fps: turned, equal first segments; pairs of two non-``exact`` members
    belong to other buckets and aren't compared here."""
    left, at, us, vs = np.arange(len(fps)), 0, [], []
    queue: list[int] = []
    two, three = np.uint64(0xFFFFFFFF << 32), np.uint64(0xFFFFFFFFFFFF << 16)
    while len(left) or at < len(queue):
        if at == len(queue):
            queue.append(int(left[0]))
            left = left[1:]
        me = queue[at]
        at += 1
        if not len(left):
            continue
        diff = fps[left] ^ fps[me]
        near = np.bitwise_count(diff & two) <= 1
        near &= np.bitwise_count(diff & three) <= 2
        if not exact[me]:
            near &= exact[left]
        near[near] = np.bitwise_count(diff[near]) <= RADIUS
        if near.any():
            found = left[near]
            us += [me] * len(found)
            vs += found.tolist()
            queue += found.tolist()
            left = left[~near]
    return us, vs


def _links_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket; a bucket that crosses batches is kept until it is whole (16 bytes a fingerprint)."""

    def links(seg: np.ndarray, key: np.ndarray, fp: np.ndarray, exact: np.ndarray) -> pa.RecordBatch:
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        cut = np.flatnonzero((seg[1:] != seg[:-1]) | (key[1:] != key[:-1])) + 1
        lo, hi = np.r_[0, cut], np.r_[cut, len(key)]
        for a, b in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist(), strict=True):
            if not exact[a:b].any():
                continue
            u, v = _forest(_rolled(fp[a:b].view(np.uint64), int(seg[a])), exact[a:b])
            us.append(fp[a:b][u])
            vs.append(fp[a:b][v])
        none = np.zeros(0, np.int64)
        return pa.record_batch([pa.array(np.concatenate([none, *x])) for x in (us, vs)], names=["u", "v"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [np.asarray(c) if c.type != pa.bool_() else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1] + 1) if (
            (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])
        ).any() else 0
        if last:
            yield links(*(c[:last] for c in cols))
        held = [c[last:] for c in cols]
    if held is not None:
        yield links(*held)


def fingerprint_links(distinct: DataFrame, chain_key: int) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints that a path of steps of at most 3 bits connects."""
    high = F.lit((1 << WIDTH) - 1)

    def segment(i: int):
        return F.shiftrightunsigned("fp", 64 - WIDTH * (i % SEGMENTS + 1)).bitwiseAND(high)

    if chain_key == 1:
        keys = F.array(*(F.struct(F.lit(i).alias("seg"), segment(i).alias("key"), F.lit(True).alias("exact")) for i in range(SEGMENTS)))
    else:
        keys = F.array(
            *(
                F.struct(
                    F.lit(i).alias("seg"),
                    F.shiftleft(segment(i), WIDTH).bitwiseOR(segment(i + 1).bitwiseXOR(F.lit(flip))).alias("key"),
                    F.lit(flip == 0).alias("exact"),
                )
                for i in range(SEGMENTS)
                for flip in (0, *(1 << b for b in range(WIDTH)))
            )
        )
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("k.seg", "k.key", "fp", "k.exact")
    parts = max(2, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.repartition(parts, "seg", "key").sortWithinPartitions("seg", "key")
    return rows.mapInArrow(_links_of_sorted, "u long, v long")


def near_duplicates(docs: DataFrame, chain_key: int = CHAIN_KEY) -> DataFrame:
    """(doc_id, fp, component_id): one row per document of ``docs`` (doc_id, text; other columns are ignored).

    Documents link when their fingerprints differ in at most 3 bits; component_id is the smallest doc_id reachable.
    Null and blank texts have fingerprint 0 and link like any other. Repeated rows give repeated results; a null doc_id
    is never the smallest unless a component has no other (then component_id is null). Very long texts are read whole. An
    empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "fp")
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-distinct")
    found = components(fingerprint_links(first.select("fp"), chain_key))
    linked = found.join(first.withColumnRenamed("fp", "node"), "node")
    lowest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = linked.join(lowest, "component").select(F.col("node").alias("fp"), "component_id")
    classes = first.join(by_print, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # written first, so that both sides of the join come from exchanges, whose large partitions Spark can split
    classes = materialize(classes, "fp-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each near-duplicate component, all columns kept.

    ``groups`` (doc_id, component_id) names the components; they are those of ``near_duplicates`` by default. Of rows that repeat a kept doc_id one stays. Rows whose component has only null doc_ids stay, as nothing tells
    them apart. The texts move once, by doc_id."""
    groups = near_duplicates(docs) if groups is None else groups
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    counts = materialize(keep.groupBy("doc_id").agg(F.count("*").alias("copies")), "keep")
    on = docs["doc_id"].cast("long").eqNullSafe(counts["doc_id"])
    # merged at every size: the kept ids grow with the documents, so they are never to be broadcast
    once = docs.join(counts.filter("copies = 1 or doc_id is null").hint("merge"), on, "left_semi")
    again = counts.filter("copies > 1 and doc_id is not null")
    if again.isEmpty():
        return once
    on = docs["doc_id"].cast("long") == again["doc_id"]
    return once.unionByName(docs.join(again, on, "left_semi").dropDuplicates(["doc_id"]))
