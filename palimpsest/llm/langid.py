"""Language identification by bit-sliced Bloom filters over character n-grams.

Each learned language has one Bloom filter; the filters are stored bit-sliced: row r of one table holds, for every
language, bit r of its filter. The rows of an n-gram's hash places and'ed together are the bitmask of all languages that
(seem to) contain it. A document's popcount for a language is the number of its n-grams whose mask has that language's
bit, corrected for the false positives that the filter's fill predicts; the highest corrected share decides.

A language's filter holds every n-gram of its sample. The filters have so many bits that the language with the most n-grams
fills at most about a sixth of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import small_batches

#: N-gram length, hash places, and bits of a filter for each n-gram of the language that has the most.
N, PLACES, BITS_PER_GRAM = 4, 3, 16
#: The sample bound: about so many labelled documents of each language are learned from, taken by the hash of doc_id. It
#: bounds the n-grams that reach the driver, and so the filters.
SAMPLE_DOCS = 3_000
UNKNOWN = "und"
#: A text is strange if no learned language knows this share of its n-grams; with fewer n-grams it says too little.
STRANGE_SHARE, STRANGE_FROM = 0.1, 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, ends, lettered): the hashes of each text's letter n-grams one after another, where each text's end, and
    whether it has a letter. Words are lower-cased and stand between blanks; an n-gram stays inside one word."""
    folded = [" " + (t or "").lower() for t in texts]
    raw = "".join([*folded, " "]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, "<u4")
    is_letter = _letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    stops = np.cumsum([len(t) for t in folded])
    kept_before = np.r_[0, np.cumsum(keep)]
    letters_before = np.r_[0, np.cumsum(is_letter)]
    starts = np.r_[0, stops[:-1]]
    lettered = letters_before[stops] > letters_before[starts] if len(stops) else np.zeros(0, bool)
    c = np.where(is_letter, points, 0)[keep].astype(np.uint64)
    if len(c) < N:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), lettered
    h = np.zeros(len(c) - N + 1, np.uint64)
    inner = np.ones(len(h), bool)
    for k in range(N):
        part = c[k : len(c) - N + 1 + k]
        h = h * np.uint64(0x100000001B3) + part
        if 0 < k < N - 1:
            inner &= part != 0
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # an n-gram belongs to the text in which it starts
    counted = np.r_[0, np.cumsum(inner)]
    ends = counted[np.minimum(kept_before[stops], len(h))] if len(stops) else np.zeros(0, np.int64)
    return h[inner], ends, lettered


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(PLACES)]


class Filters:
    """The bit-sliced filters: tables with a row for each bit of a filter, each row holding 64 languages."""

    def __init__(self, grams: dict[str, np.ndarray], prior: dict[str, int]):
        self.langs = sorted(prior)
        self.bits = 1 << max(10, (BITS_PER_GRAM * max(map(len, grams.values()), default=0)).bit_length())
        self.tables = [np.zeros(self.bits, np.uint64) for _ in range(-(-len(self.langs) // 64))]
        self.false_rate = []
        for i, lang in enumerate(self.langs):
            table, bit = self.tables[i // 64], np.uint64(1 << (i % 64))
            for rows in _places(grams.get(lang, np.zeros(0, np.uint64)), self.bits):
                table[rows] |= bit
            fill = np.count_nonzero(table & bit) / self.bits
            self.false_rate.append(min(0.99, fill**PLACES))
        self.known = any(map(len, grams.values()))
        self.usual = min(self.langs, key=lambda x: (-prior[x], x)) if self.langs else UNKNOWN

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, score, whether the text is strange to all learned languages) of each text."""
        hashes, ends, lettered = gram_hashes(texts)
        starts = np.r_[0, ends[:-1]]
        total = np.maximum(ends - starts, 1)
        rows = _places(hashes, self.bits)
        scores = np.zeros((len(self.langs), len(texts)))
        for t, table in enumerate(self.tables):
            masks = table[rows[0]]
            for r in rows[1:]:
                masks &= table[r]
            for i in range(64 * t, min(64 * t + 64, len(self.langs))):
                before = np.r_[0, np.cumsum((masks >> np.uint64(i % 64)).astype(np.uint8) & np.uint8(1), dtype=np.int64)]
                count = before[ends] - before[starts]
                wrong = self.false_rate[i]
                scores[i] = np.clip((count - total * wrong) / (1 - wrong), 0, None)
        langs, sure = [], []
        best = scores.argmax(0) if self.langs else np.zeros(len(texts), int)
        for k in range(len(texts)):
            if not lettered[k] or not self.langs:
                langs.append(UNKNOWN)
                sure.append(0.0)
            elif scores[best[k], k] <= 0:
                langs.append(self.usual)
                sure.append(0.0)
            else:
                langs.append(self.langs[best[k]])
                sure.append(float(scores[best[k], k] / scores[:, k].sum()))
        strange = (ends - starts >= STRANGE_FROM) & ~(scores >= STRANGE_SHARE * total).any(0) if self.known else np.zeros(len(texts), bool)
        return langs, sure, strange.tolist()


def fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id's text, modulo 3; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = np.array(batch.column(1).to_pylist(), object)
        for lang in sorted(set(langs)):
            h = np.unique(gram_hashes(texts[langs == lang].tolist())[0])
            yield pa.record_batch([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64))], names=["lang", "gram"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from text and lang of the documents outside fold 1.

    Per language about ``sample_docs`` documents are learned from. What reaches the driver is the distinct n-grams of
    these documents for each language that the labels name, 8 bytes each."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = known.filter("lang is not null and text is not null and doc_id is not null").filter(fold() != 1)
    prior = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not prior:
        return Filters({}, {})
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, sample_docs / n)) for k, n in sorted(prior.items())], "lang string, rate double")
    # as many rows as languages
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = known.join(F.broadcast(rates), "lang").filter(place < F.col("rate"))
    found = sample.select("lang", "text").mapInArrow(_grams, "lang string, gram long").distinct().toArrow()
    by_lang = {}
    langs, hashes = found.column(0).combine_chunks().dictionary_encode(), found.column(1).to_numpy()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        by_lang[lang] = hashes[langs.indices.to_numpy() == i].view(np.uint64)
    return Filters(by_lang, prior)


def _decided(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sure = [], []
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 250):
                a, b, _ = filters.decide(texts[k : k + 250])
                langs += a
                sure += b
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of ``docs`` (doc_id, text; other columns are ignored).

    Whole texts of any length are read. ``und`` with score 0 for a null text or one without letters, or where nothing was
    learned; the most frequent learned language with score 0 where no n-gram is known. score: the language's share of all corrected popcounts. Ties go to
    the first language in order. Repeated rows give repeated results; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _decided(filters), "doc_id long, lang_pred string, score double"
    )


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn outside fold 1, predict every row; held_out is false for a null doc_id."""
    found = predict(docs, learn(docs))
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _spoken(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, keep = batch.column(at).to_pylist(), []
            for k in range(0, len(texts), 250):
                langs, _, strange = filters.decide(texts[k : k + 250])
                keep += [x != UNKNOWN and not y for x, y in zip(langs, strange, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told, all columns kept.

    Null texts, texts without letters and texts of which no learned language knows a tenth of the n-grams, beyond what its
    filter's false positives explain (an unseen script), go. Texts with too few n-grams to tell stay, and where nothing
    could be learned every text with a letter. Rows that repeat are judged alike; very long texts are read whole;
    an empty table gives no rows."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_spoken(learn(docs)), docs.schema)
