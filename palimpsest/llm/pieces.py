"""Texts cut into the pieces of the byte-level split pattern (GPT-2's), for a whole batch at once.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space, where white space before a word leaves its
last character to the word if that is a blank. So cuts lie where the class of characters changes, before the last white
space of a run, and around contractions; they are found for all bytes of a batch together. A special token's string is a
piece of its own, and what stands beside it is cut as if it were a text of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4
# Fixed value: Unicode white space.
WHITE_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# Fixed value: letters and numbers that Unicode 16 added; the split pattern's engine knows these and no newer ones.
ADDED_RANGES = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
BLANK, APOSTROPHE = 0x20, 0x27
# What an apostrophe takes with it, by length.
SHORT, LONG = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind:
            out[point] = kind
    number = regex.compile(r"\p{N}").match
    for a, b in ADDED_RANGES:
        out[a : b + 1] = [NUMBER if number(chr(point)) else LETTER for point in range(a, b + 1)]
    for a, b in WHITE_RANGES:
        out[a : b + 1] = WHITE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 ``data`` the class of its character."""
    table = classes()
    first = table[:256].copy()
    first[128:] = 0
    out = first[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.r_[data, np.zeros(4, np.uint8)]
        b0 = data[lead].astype(np.int32)
        b1, b2, b3 = (padded[lead + k].astype(np.int32) & 63 for k in (1, 2, 3))
        two, three = b0 < 0xE0, b0 < 0xF0
        point = np.where(two, (b0 & 31) << 6 | b1, np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = table[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        size = 2 + (~two).astype(np.int64) + (~three).astype(np.int64)
        for k in (1, 2, 3):
            inside = (size > k) & (lead + k < len(data))
            out[lead[inside] + k] = kind[inside]
    return out


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start, in ascending order. ``data``: UTF-8 of texts one after another; ``bounds``: where texts start."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    edge = np.zeros(n + 4, bool)
    edge[bounds] = True
    edge[0] = edge[n:] = True
    start = np.zeros(n + 4, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[:n] |= edge[:n]

    after = np.flatnonzero(start[1:n] & ~edge[1:n] & (kind[:-1] == WHITE)) + 1
    last = after - 1
    for _ in range(3):
        last -= (data[last] & 0xC0) == 0x80
    start[last] = True
    start[after[data[after - 1] == BLANK]] = False

    at = np.flatnonzero((data == APOSTROPHE) & start[:n])
    at = at[~edge[at + 1]]
    if len(at):
        padded = np.r_[data, np.zeros(2, np.uint8)]
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [x[0] for x in SHORT])
        long = np.zeros(len(at), bool)
        for x in LONG:
            long |= (one == x[0]) & (two == x[1])
        long &= ~edge[at + 2]
        for hit, size in ((at[short], 2), (at[long], 3)):
            start[hit + 1] = False
            start[hit + size] = True
    return np.flatnonzero(start[:n])


@dataclass
class Pieces:
    """A batch's distinct pieces, and how the texts are made of them."""

    data: np.ndarray  # bytes of the distinct pieces, one after another
    offsets: np.ndarray  # where each distinct piece starts in them, and the end
    code: np.ndarray  # for each piece in order which distinct one it is
    ends: np.ndarray  # for each text how many pieces end with it
    special: dict[int, int]  # distinct pieces that are special tokens, with the token's id


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cut(texts: pa.Array, special: dict[str, int]) -> Pieces:
    """The pieces of ``texts``, a string array; a null text has none."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("")
    data, offsets = _buffers(texts)
    cuts, found = [offsets[:-1]], []
    if special:
        # in order of place, then as the list names them
        names = regex.compile(b"|".join(regex.escape(s.encode()) for s in special))
        raw = data.tobytes()
        if any(s.encode() in raw for s in special):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found += [(m.start(), m.end(), special[m.group().decode()]) for m in names.finditer(raw, a, b)]
            cuts += [np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)]
    bounds = np.concatenate(cuts)
    starts = piece_starts(data, bounds[bounds < len(data)])
    if found:
        inside = np.zeros(len(data) + 1, bool)
        for a, b, _ in found:
            inside[a + 1 : b] = True
        starts = starts[~inside[starts]]
    ends = np.searchsorted(starts, offsets[1:])
    stops = np.r_[starts, len(data)].astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(data))])
    coded = whole.dictionary_encode()
    code = coded.indices.to_numpy()
    own, at = _buffers(coded.dictionary)
    ids = {int(code[i]): token for i, token in zip(np.searchsorted(starts, [x[0] for x in found]).tolist(), [x[2] for x in found], strict=True)} if found else {}
    return Pieces(own, at, code, ends, ids)


def gathered(pool: np.ndarray, first: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The runs pool[first : first + n] one after another; ``ends`` is the running sum of ``n``."""
    if not len(ends):
        return pool[:0]
    kind = np.int32 if max(len(pool), int(ends[-1])) < 1 << 31 else np.int64
    at = np.repeat((first - ends + n).astype(kind), n)
    at += np.arange(len(at), dtype=kind)
    return pool[at]


def spread(pieces: Pieces, pool: np.ndarray, size: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's end), from the ids of the distinct pieces, their sizes and where each one's
    start in ``pool`` (one after another by default)."""
    first = np.cumsum(size) - size if first is None else first
    n = size[pieces.code]
    ends = np.cumsum(n)
    return gathered(pool, first[pieces.code], n, ends), np.r_[0, ends][pieces.ends]


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` bytes of text (column 1), whatever the batches that come in hold; a single
    row is never cut."""
    held: list[pa.RecordBatch] = []
    full = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = _buffers(batch.column(1))[1]
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max(0, limit - full), "right")) - 1)
            b = min(b, batch.num_rows)
            held.append(batch.slice(a, b - a))
            full += int(offsets[b] - offsets[a])
            if full >= limit or b < batch.num_rows:
                yield _joined(held)
                held, full = [], 0
            a = b
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)
