"""Content-addressed store of token ids.

Every document's ids (with an end id) are cut into chunks where a rolling hash over the last ids hits a fixed pattern,
so equal passages give equal chunks whatever stands before them. A chunk is stored once under its BLAKE2b digest; a
document is a recipe, the list of its chunks' digests. Recipes lie in files in ascending doc_id order, in blocks whose
hashes form a Merkle tree up to one root in the manifest.

Tables under the store's path, all Parquet: ``data/kind=0`` (digest, payload: ids as little-endian unsigned 16- or
32-bit integers), ``recipes`` (part, block, at, doc_id, n_tokens, digests, after), ``manifest`` (part, block,
n_docs, n_tokens, low, high, root).
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm.pieces import by_bytes, cut, spread
from palimpsest.llm.storage import scratch, small_batches

END_ID = 0
#: Pieces that go to the library as one text, and bytes of text whose distinct pieces are encoded together.
GROUP, TOGETHER = 500, 1 << 23
#: From so many known pieces on, a worker forgets them before the next batch; only speed and memory depend on it.
KEPT = 700_000
#: Ids that the rolling hash sees, least and most ids of a chunk, and the bits that decide a cut (one in 256 places).
WINDOW, LEAST, MOST, CUT_BITS = 16, 64, 1024, 8
#: Recipes in a block of the Merkle tree.
BLOCK = 1024
FACTOR, BASE = np.uint32(2654435761), 0x01000193


class LibraryEncoder:
    """Encodes batches of texts with the tokenizers library, each distinct piece of the split pattern once while it is kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer = tokenizer
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        between = self._asked(["\n"])[0]
        if len(between) != 1:
            raise ValueError("a line feed isn't one id in this tokenizer")
        self.between = between[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used, self.ends = 0, np.zeros(1 << 14, np.int64)

    def _asked(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces that aren't known yet.

        Pieces with a word go to the library joined by line feeds, whose id then tells them apart; a line feed before and
        behind such a piece changes nothing in how it is cut. White space and special tokens go one by one."""
        names = {x.encode() for x in self.special}
        alone = [p for p in pieces if p in names or ((p[-1] <= 0x20 or p[-1] >= 0x80) and p.decode().isspace())]
        single = set(alone)
        joined = [p for p in pieces if p not in single] if single else pieces
        groups = [joined[k : k + GROUP] for k in range(0, len(joined), GROUP)]
        found = self._asked([b"\n".join(g).decode() for g in groups] + [p.decode() for p in alone])
        parts, sizes = [], []
        for group, ids in zip(groups, found, strict=False):
            at = np.flatnonzero(ids == self.between)
            if len(at) != len(group) - 1:
                raise ValueError("a line feed isn't an id of its own in this tokenizer")
            sizes.append(np.diff(np.r_[-1, at, len(ids)]) - 1)
            parts.append(np.delete(ids, at))
        parts += found[len(groups) :]
        sizes.append([len(x) for x in found[len(groups) :]])
        fresh, ends = np.concatenate(parts), np.cumsum(np.concatenate(sizes)).astype(np.int64)
        first = len(self.known)
        self.known.update(zip([*joined, *alone], range(first, first + len(pieces)), strict=True))
        self.pool = _room(self.pool, self.used + len(fresh))
        self.pool[self.used : self.used + len(fresh)] = fresh
        self.ends = _room(self.ends, len(self.known))
        self.ends[first : len(self.known)] = self.used + ends
        self.used += len(fresh)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them); a null text has no ids."""
        pieces = cut(texts, self.special)
        if len(self.known) > KEPT:
            self._forget()
        raw, at = pieces.data.tobytes(), pieces.offsets.tolist()
        names = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        if new := [p for p in names if p not in self.known]:
            self._learn(new)
        k = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        first = np.where(k > 0, self.ends[k - 1], 0)
        return spread(pieces, self.pool[: self.used], self.ends[k] - first, first)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array with place for ``n`` values at least."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder per worker process and file."""
    return LibraryEncoder(path)


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Places i where a chunk may end after ids[i]: the hash of the WINDOW ids up to i has zeros in its deciding bits."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * FACTOR
    h ^= h >> np.uint32(15)
    width, power = 1, BASE
    while width < WINDOW:
        h[width:] = h[width:] + h[:-width] * np.uint32(power)
        power = power * power & 0xFFFFFFFF
        width *= 2
    return np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0)


def chunk_ends(n: int, places: list[int]) -> list[int]:
    """Ends of a document's chunks; places: allowed cuts, counted from its start, in ascending order."""
    ends, start = [], 0
    for p in places:
        while p + 1 - start > MOST:
            start += MOST
            ends.append(start)
        if p + 1 - start >= LEAST and p + 1 < n:
            start = p + 1
            ends.append(start)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return [*ends, n]


_ROWS = pa.schema(
    [
        ("kind", pa.int32()), ("route", pa.int64()), ("digest", pa.binary()), ("payload", pa.binary()),
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("after", pa.list_(pa.int64())),
    ]
)
_ROWS_SQL = "kind int, route long, digest binary, payload binary, doc_id long, n_tokens long, digests array<binary>, after array<long>"


def _chunked(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path)
        seen: set[bytes] = set()
        for batch in by_bytes(batches, TOGETHER):
            flat, ends = encode(batch.column(1))
            count = len(ends)
            # the end id goes behind each document
            ids = np.insert(flat, ends, END_ID)
            ends = ends + np.arange(1, count + 1)
            narrow = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
            width, raw = narrow.itemsize, narrow.tobytes()
            mark = width.to_bytes(1, "little")
            places = cut_places(ids)
            starts = np.r_[0, ends[:-1]]
            low, high = np.searchsorted(places, starts + LEAST - 1), np.searchsorted(places, ends)
            names, payloads, routes, digests, after = [], [], [], [], []
            for doc_id, start, stop, a, b in zip(batch.column(0).to_pylist(), starts.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
                own, at = [], start
                stops = chunk_ends(stop - start, (places[a:b] - start).tolist())
                for end in stops:
                    payload = mark + raw[at * width : (start + end) * width]
                    at = start + end
                    digest = hashlib.blake2b(payload, digest_size=16).digest()
                    own.append(digest)
                    if digest not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(digest)
                        names.append(digest)
                        payloads.append(payload)
                digests.append(own)
                after.append([stop - start - end for end in stops])
                routes.append(int.from_bytes(hashlib.blake2b(b"".join(own) + str(doc_id).encode(), digest_size=8).digest(), "little", signed=True))
            yield _rows(len(names), kind=0, route=[int.from_bytes(d[:8], "little", signed=True) for d in names], digest=names, payload=payloads)
            yield _rows(count, kind=1, route=routes, doc_id=batch.column(0), n_tokens=ends - starts, digests=digests, after=after)

    return run


def _rows(count: int, kind: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(count, kind, np.int32)
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _ROWS], schema=_ROWS)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk come to one partition; the first one stays (16 bytes are kept for each chunk)."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keep.append(kind == 1 or digest not in seen)
            if kind == 0:
                seen.add(digest)
        yield batch.filter(pa.array(keep))


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None) -> str:
    """Encode ``docs`` (doc_id, text), write the store and return its path (under the shared folder by default)."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_chunked(tokenizer), _ROWS_SQL)
    once = rows.repartition(parts, "route").mapInArrow(_once, _ROWS_SQL)
    # ids are plain integers of one width, which the codec packs well
    once.drop("route").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")

    recipes = spark.read.schema(_DATA_SQL).parquet(f"{path}/data").filter("kind = 1")
    ordered = recipes.select("doc_id", "n_tokens", "digests", "after").repartitionByRange(
        parts, F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("digests")
    )
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "digests")
    # the id holds the partition above 33 bits of a count
    numbered = ordered.withColumn("n", F.monotonically_increasing_id()).withColumn("at", F.col("n").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered.select(
        F.shiftright("n", 33).cast("int").alias("part"), F.floor(F.col("at") / BLOCK).alias("block"), "at", "doc_id", "n_tokens", "digests", "after"
    ).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(read_recipes(spark, path)).write.parquet(f"{path}/manifest")
    return path


_DATA_SQL = "digest binary, payload binary, doc_id long, n_tokens long, digests array<binary>, after array<long>, kind int"
_RECIPES_SQL = "part int, block long, at long, doc_id long, n_tokens long, digests array<binary>, after array<long>"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPES_SQL).parquet(f"{path}/recipes")


def _manifest(recipes: DataFrame) -> DataFrame:
    """Merkle nodes: a row per block over the hashes of its recipes (doc_id, size, digests in order), per part over its
    blocks (block null), and one root."""

    def node(df: DataFrame, order: str, leaf: str, *keys: str) -> DataFrame:
        joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, F.hex(leaf).alias("h")))), lambda x: x["h"]))
        return df.groupBy(*keys).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("low").alias("low"),
            F.max("high").alias("high"), F.unhex(F.sha2(joined, 256)).alias("root"),
        )

    names = F.array_join(F.transform("digests", F.hex), ",")
    recipe = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", names)
    leaf = F.unhex(F.sha2(recipe, 256)).alias("leaf")
    leaves = recipes.select("part", "block", "at", F.lit(1).cast("long").alias("n_docs"), "n_tokens", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"), leaf)
    blocks = node(leaves, "at", "leaf", "part", "block")
    parts = node(blocks, "block", "root", "part").withColumn("block", F.lit(None).cast("long"))
    root = node(parts, "part", "root", "block").withColumn("part", F.lit(None).cast("int"))
    return blocks.unionByName(parts).unionByName(root)


#: crc32's generator polynomial, bits reversed.
POLY = np.uint32(0xEDB88320)


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[k, b]: the crc with just bit b set, after 2^k more zero bytes."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (POLY * (one & np.uint32(1)))
    table = [one]
    for _ in range(47):
        table.append(_apply(table[-1], table[-1]))
    return np.stack(table)


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for b in range(32):
        out ^= matrix[b] * ((crc >> np.uint32(b)) & np.uint32(1))
    return out


def shifted_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """crc32 values after so many more bytes; the crc of a whole is the exclusive or of its parts' shifted ones."""
    crc, zeros, k = crc.astype(np.uint32), zeros.astype(np.int64), 0
    while (zeros >> k).any():
        odd = ((zeros >> k) & 1).astype(bool)
        crc[odd] = _apply(_shifts()[k], crc[odd])
        k += 1
    return crc


def payload_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def _checked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, crcs = [], []
        for digest, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if hashlib.blake2b(payload, digest_size=16).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} does not hold what its name says")
            ids = payload_ids(payload)
            sizes.append(len(ids))
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, at, crc, after, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        moved = shifted_crc(crc, after * 4).astype(np.int64)
        yield pa.record_batch([pa.array(part), pa.array(at), pa.array(moved), pa.array(n)], names=["part", "at", "crc", "n"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files.

    The recipes are hashed again and held against the Merkle manifest up to its root. Chunk payloads are read and checked
    against their digests where they lie; only their sizes and crcs meet the recipes, and a document's crc is put together
    from its chunks'. A changed recipe, block or root, a damaged chunk or one that is missing is an error.
    """
    small_batches(spark)
    if not verify_store(spark, path):
        raise ValueError(f"the recipes under {path} are not those that the manifest names")
    stored = _chunks(spark, path)
    chunks = stored.mapInArrow(_checked_chunks, "digest binary, n long, crc long")
    recipes = read_recipes(spark, path)
    places = recipes.select("part", "at", F.explode(F.arrays_zip("digests", "after")).alias("x"))
    places = places.select("part", "at", F.col("x.digests").alias("digest"), F.col("x.after").alias("after"))
    met = places.join(chunks, "digest", "left").select(
        "part", "at", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing from the store")).cast("long")).alias("crc"), "after", "n"
    )
    whole = met.mapInArrow(_shifted, "part int, at long, crc long, n long").groupBy("part", "at").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_read"))

    manifest = spark.read.parquet(f"{path}/manifest").filter("part is not null")
    by_part = manifest.filter("block is null").select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("part_start"))
    ordered = Window.partitionBy("part").orderBy("block")
    by_block = manifest.filter("block is not null").select("part", "block", (F.sum("n_tokens").over(ordered) - F.col("n_tokens")).alias("block_start"))
    in_block = Window.partitionBy("part", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("part", "block", "at", "doc_id", "n_tokens", F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0)).alias("before"))
    placed = placed.join(by_block, ["part", "block"]).join(by_part, "part")
    return placed.join(whole, ["part", "at"]).select(
        "doc_id",
        (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"),
        F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is incomplete")).cast("long")).alias("n_tokens"),
        "ids_crc32",
    )


def store_and_read(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the store for ``docs`` (doc_id, text; other columns are ignored) and read it back, one row per row.

    A null text counts as empty: just the end id. Rows are ordered by doc_id (nulls first), then by size and content,
    so repeated rows lie side by side, each with its own place. An empty table gives no rows."""
    return read_store(docs.sparkSession, write_store(docs, tokenizer, path))


def verify_store(spark: SparkSession, path: str) -> bool:
    """Whether the manifest's hashes, counts and root follow from the recipes as they lie in the files."""
    cols = ["part", "block", "n_docs", "n_tokens", "low", "high", "root"]
    kept = spark.read.parquet(f"{path}/manifest").select(F.struct(*cols).alias("kept"))
    made = _manifest(read_recipes(spark, path)).select(F.struct(*cols).alias("made"))
    one = reduce(Column.__and__, [F.col(f"kept.{c}").eqNullSafe(F.col(f"made.{c}")) for c in ("part", "block")])
    return kept.join(made, one, "full").filter(~F.col("kept").eqNullSafe(F.col("made"))).isEmpty()


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_DATA_SQL).parquet(f"{path}/data").filter("kind = 0").select("digest", "payload")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for digests, payloads, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            for digest, payload in zip(digests, payloads, strict=True):
                if payload is None or hashlib.blake2b(payload, digest_size=16).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is missing or damaged")
            ids.append(np.concatenate([payload_ids(p) for p in payloads]).astype(np.int64))
            if len(ids[-1]) != n:
                raise ValueError("a document is incomplete")
        yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document, the end id included, put together from its recipe's chunks; every chunk is checked
    against its digest."""
    small_batches(spark)
    recipes = read_recipes(spark, path)
    places = recipes.select("part", "at", "doc_id", "n_tokens", F.posexplode("digests").alias("i", "digest"))
    met = places.join(_chunks(spark, path), "digest", "left").groupBy("part", "at", "doc_id", "n_tokens")
    xs = met.agg(F.array_sort(F.collect_list(F.struct("i", "digest", "payload"))).alias("xs"))
    return xs.select("doc_id", "xs.digest", "xs.payload", "n_tokens").mapInArrow(_rebuilt, "doc_id long, ids array<long>")
