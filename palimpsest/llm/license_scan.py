"""Licence scan by a positional rare-token index.

Postings hold (template, position) for each template's rarest words, by IDF over the corpus: so many that the others
have less weight than a match needs. So every match has one of them in its place, whatever else the file holds. All their
places in a file are looked up; each hit names an offset (file position - template position). An offset with enough of the
template's weight is a match if all mandatory key phrases of that template stand in the aligned part of the file.

The base phrases use the same index: a phrase is looked up by its rarest word and its other words are verified at their
relative positions, at every place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import small_batches
from palimpsest.llm.words import alnum_words

# Phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Short notices by label, with the phrases that must stand in an aligned match.
TEMPLATES = {
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted", "free of charge"),
    ),
    "apache-2": ("licensed under the apache license version 2 0", ("apache license", "version 2")),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use", "source and binary forms"),
    ),
    "gpl": ("licensed under the gnu general public license", ("general public license",)),
    "lgpl": ("licensed under the gnu lesser general public license", ("lesser general public license",)),
    "mpl-2": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "cc-by": ("licensed under cc by 4 0", ("cc by 4",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc0": ("released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    "proprietary": ("copyright all rights reserved", ("all rights reserved",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software",)),
}
#: The share of a template's weight that must align.
MIN_SHARE = 0.6


def _words(phrase: str) -> tuple[bytes, ...]:
    return tuple(phrase.encode().split())


def vocabulary() -> list[bytes]:
    texts = [*BASE_PHRASES, *(t for t, _ in TEMPLATES.values()), *(k for _, ks in TEMPLATES.values() for k in ks)]
    return sorted({w for t in texts for w in _words(t)})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = frozenset(vocabulary())
    df: Counter[bytes] = Counter()
    n = 0
    for batch in batches:
        for text in batch.column(0):
            df.update(known.intersection(alnum_words(text.as_py())))
        n += batch.num_rows
    words = [b"", *df]
    yield pa.record_batch(
        [pa.array([w.decode() for w in words]), pa.array([n, *df.values()], pa.int64())], names=["word", "n"]
    )


def document_frequencies(docs: DataFrame) -> dict[bytes, int]:
    """Documents that hold each licence word, over the whole corpus; '' counts the documents. As many rows reach the
    driver as the licence vocabulary has words."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("text").cast("string")).mapInArrow(_count_words, "word string, n long")
    return {r.word.encode(): r.n for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Postings of the templates' words, weighted by IDF over the corpus."""

    def __init__(self, df: dict[bytes, int]):
        n = df.get(b"", 0)
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary()}
        self.templates = {k: _words(t) for k, (t, _) in TEMPLATES.items()}
        self.required = {k: [_words(p) for p in ps] for k, (_, ps) in TEMPLATES.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.weight = {k: sum(self.idf[w] for w in words) for k, words in self.templates.items()}
        for label, words in self.templates.items():
            rest = self.weight[label]
            for at in sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], i)):
                # what is left can't make a match by itself; the margin covers rounding
                if rest < (MIN_SHARE - 1e-9) * self.weight[label]:
                    break
                self.postings[words[at]].append((label, at))
                rest -= self.idf[words[at]]
        self.phrases = []
        for phrase, label in BASE_PHRASES.items():
            words = _words(phrase)
            rare = max(range(len(words)), key=lambda i: (self.idf[words[i]], -i))
            self.phrases.append((label, words, rare))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], dict[str, float]]:
        """Base places as (label, start); labels of the aligned templates with the share of weight that aligned."""
        idf = self.idf
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in idf:
                places[w].append(i)
        base = []
        for label, phrase, rare in self.phrases:
            for i in places.get(phrase[rare], ()):
                start = i - rare
                if start >= 0 and tuple(words[start : start + len(phrase)]) == phrase:
                    base.append((label, start))
        offsets = {(label, i - at) for w, found in places.items() for label, at in self.postings.get(w, ()) for i in found}
        best: dict[str, float] = {}
        for label, offset in offsets:
            template = self.templates[label]
            share = sum(idf[w] for k, w in enumerate(template) if 0 <= offset + k < len(words) and words[offset + k] == w)
            share /= self.weight[label]
            if share >= MIN_SHARE and share > best.get(label, 0.0):
                part = words[max(0, offset) : offset + len(template)]
                if all(any(tuple(part[k : k + len(p)]) == p for k in range(len(part))) for p in self.required[label]):
                    best[label] = share
        return base, best


def _scan_batches(df: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = alnum_words(text.as_py())
                base, aligned = index.scan(words)
                starts = [s for _, s in base]
                base_labels = {label for label, _ in base}
                out.append(
                    {
                        "doc_id": doc_id,
                        "n_words": len(words),
                        "n_base": len(base),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base_labels)),
                        "labels": ",".join(sorted(base_labels | aligned.keys())),
                        "score": 1.0 if base else min(1.0, max(aligned.values(), default=0.0)),
                        "places": [{"label": k, "start": s} for k, s in sorted(base, key=lambda x: (x[1], x[0]))],
                        "aligned": sorted(aligned.items()),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return run


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
        ("aligned", pa.map_(pa.string(), pa.float64())),
    ]
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    ``places`` lists every base phrase with its start word; ``aligned`` maps each template label to the share of its IDF
    weight that stands at the agreed offset. score: 1 with a base phrase, else the best aligned share, else 0. A null
    text counts as empty: no words, empty labels, score 0, null first and last word. Repeated rows give repeated
    results; an empty table gives no rows.
    """
    df = document_frequencies(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scan_batches(df),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, places array<struct<label:string,start:long>>, aligned map<string,double>",
    )
