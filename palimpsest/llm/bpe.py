"""Byte-level BPE by backtracking, decoding by an offset table.

Encoding: an Aho-Corasick automaton over the vocabulary gives, for each place of a piece, the longest token that starts
there. The encoder takes longest tokens, but only if the pair with the token before is compatible, that is if merging the
two tokens' bytes by rank would give back exactly these two; else it falls back to the next shorter token that is a
prefix, and else it drops the token before. Places from which no compatible continuation exists are never entered again,
so the work is linear in the piece. Pair compatibility is kept in a table as it is found.

A batch's distinct pieces are encoded side by side: the automaton reads one byte of every piece at a time, and every piece
takes one step of the search at a time.

Decoding: one byte string of all tokens and a table of offsets into it; a gather builds the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.pieces import by_bytes, cut, gathered, spread
from palimpsest.llm.storage import small_batches

#: Bytes of text that are encoded together, places of the pair table, bytes that one lane of the automaton starts in, and
#: the number of unfinished pieces below which they are finished one by one. Only speed and memory depend on these.
TOGETHER, TABLE_BITS, LANE, FEW = 1 << 22, 18, 64, 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for the letters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _mixed(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class Automaton:
    """Aho-Corasick over byte strings. A node's children have consecutive numbers in the order of their bytes, so a bit
    per byte and a count of lower bits name the child."""

    def __init__(self, tokens: list[bytes]):
        """``tokens`` by id; empty ones are no tokens."""
        size = np.array([len(t) for t in tokens], np.int64)
        blob = np.frombuffer(b"".join(tokens), np.uint8)
        first = np.cumsum(size) - size
        node = np.zeros(len(tokens), np.int64)
        edges, self.levels, count = [], [np.zeros(1, np.int64)], 1
        for depth in range(int(size.max(initial=0))):
            here = np.flatnonzero(size > depth)
            keys, inverse = np.unique(node[here] << 8 | blob[first[here] + depth], return_inverse=True)
            node[here] = count + inverse
            edges.append(keys)
            self.levels.append(np.arange(count, count + len(keys)))
            count += len(keys)
        self.bits = np.zeros(count * 4, np.uint64)
        self.child = np.zeros(count * 4, np.int32)
        at = 1
        for keys in edges:
            parent, byte = keys >> 8, keys & 255
            np.bitwise_or.at(self.bits, parent * 4 + (byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
            word = parent * 4 + (byte >> 6)
            new = np.r_[True, word[1:] != word[:-1]]
            self.child[word[new]] = at + np.flatnonzero(new)
            at += len(keys)
        #: the longest token that ends at a node, and the node of the next shorter one
        self.depth = np.zeros(count, np.int32)
        self.fail = np.zeros(count, np.int32)
        self.token = np.full(count, -1, np.int32)
        self.token[node[size > 0]] = np.flatnonzero(size > 0)
        self.own = self.token.copy()
        self.next = np.zeros(count, np.int32)
        for depth, keys in enumerate(edges):
            nodes, parent, byte = self.levels[depth + 1], keys >> 8, (keys & 255).astype(np.uint8)
            self.depth[nodes] = depth + 1
            if depth:
                self.fail[nodes] = self.step(self.fail[parent], byte)
            back = self.fail[nodes]
            mine = self.own[nodes] >= 0
            self.next[nodes] = np.where(self.token[back] >= 0, np.where(self.own[back] >= 0, back, self.next[back]), 0)
            self.token[nodes] = np.where(mine, self.own[nodes], self.token[back])
        self.levels = None

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node after reading one byte from each state."""
        state = state.astype(np.int32)
        out = np.zeros(len(state), np.int32)
        left, byte = np.arange(len(state)), byte.astype(np.int32)
        high, low = byte >> 6, (byte & 63).astype(np.uint64)
        while len(left):
            word = state * 4 + high
            bits = self.bits[word] >> np.uint64(0)
            hit = ((bits >> low) & np.uint64(1)).astype(bool)
            found = np.flatnonzero(hit)
            below = bits[found] & ((np.uint64(1) << low[found]) - np.uint64(1))
            out[left[found]] = self.child[word[found]] + np.bitwise_count(below)
            rest = np.flatnonzero(~hit & (state > 0))
            left, state, high, low = left[rest], self.fail[state[rest]], high[rest], low[rest]
        return out

    def longest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each byte of ``data`` the longest token that starts there and stays inside its piece, else -1."""
        out = np.full(len(data) + 1, -1, np.int32)
        begin, stop = offsets[:-1], offsets[1:]
        lanes = -(-(stop - begin) // LANE)
        if lanes.max(initial=0) > 1:
            whole = np.repeat(np.arange(len(begin)), lanes)
            k = np.arange(len(whole)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            begin, stop = begin[whole] + k * LANE, stop[whole]
        place, limit = begin.copy(), np.minimum(begin + LANE, stop)
        keep = place < stop
        place, limit, stop = place[keep], limit[keep], stop[keep]
        state = np.zeros(len(place), np.int32)
        while len(place):
            state = self.step(state, data[place])
            # later ends come later, so of the tokens with one start the longest stays
            at, node, own, bound = place, state, self.token[state], limit
            shorter = False
            while len(at):
                size = self.depth[node] if shorter else self.size_at(node)
                start = at - size + 1
                ok = (own >= 0) & (start < bound)
                out[start[ok]] = own[ok]
                more = np.flatnonzero(self.after(node, shorter) > 0)
                node = self.after(node, shorter)[more]
                at, bound, own, shorter = at[more], bound[more], self.own[node], True
            place = place + 1
            # a lane goes on beyond its bytes only while a token that starts in them may
            keep = np.flatnonzero((place < stop) & (place - self.depth[state] < limit))
            place, limit, stop, state = place[keep], limit[keep], stop[keep], state[keep]
        return out

    def size_at(self, node: np.ndarray) -> np.ndarray:
        """The length of the longest token that ends at each node."""
        return np.where(self.own[node] >= 0, self.depth[node], self.depth[self.next[node]])

    def after(self, node: np.ndarray, shorter: bool) -> np.ndarray:
        """The node of the token after the longest one."""
        if shorter:
            return self.next[node]
        return np.where(self.own[node] >= 0, self.next[node], self.next[self.next[node]])


class Codec:
    """Encoder and decoder for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        vocab = {as_bytes[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}

        size = 1 + max([*vocab.values(), *self.special.values()])
        token = [b""] * size
        for t, i in vocab.items():
            token[i] = t
        shown = list(token)
        for t, i in self.special.items():
            shown[i] = t.encode()
        self.blob = np.frombuffer(b"".join(shown), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in shown])]).astype(np.int64)
        self.length = np.array([len(t) for t in token], np.int64)
        self.automaton = Automaton(token)
        self.shorter = np.full(size, -1, np.int64)
        for t, i in vocab.items():
            self.shorter[i] = next((vocab[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in vocab), -1)

        # each merge's rank by the pair it joins; the rank and the pair that a token comes from
        self.made, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        pairs, ranks = [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[as_bytes[x]] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            pairs.append(a << 32 | b)
            ranks.append(rank)
            if self.made[whole := vocab[token[a] + token[b]]] < 0:
                self.made[whole], self.left[whole], self.right[whole] = rank, a, b
        self._index(np.array(pairs, np.int64), np.array(ranks, np.int64))
        self.pairs = np.full(1 << TABLE_BITS, -1, np.int64)
        self.fits = np.zeros(1 << TABLE_BITS, bool)
        self.sound = self._sound()

    def _index(self, pairs: np.ndarray, ranks: np.ndarray) -> None:
        """An open hash table of the merges; of a pair that is listed twice the last rank holds."""
        self.bits = max(4, int(len(pairs) * 6).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int64)
        last = dict(zip(pairs.tolist(), ranks.tolist(), strict=True))
        left, value = np.fromiter(last, np.int64, len(last)), np.fromiter(last.values(), np.int64, len(last))
        at, self.probes = _mixed(left, self.bits), 0
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            done = self.slots[at] == left
            self.ranks[at[done]] = value[done]
            left, value, at = left[~done], value[~done], (at[~done] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge that joins each pair, else -1."""
        pair = left << 32 | right
        at, out = _mixed(pair, self.bits), np.full(len(pair), -1, np.int64)
        todo = np.arange(len(pair))
        for _ in range(self.probes):
            seen = self.slots[at]
            hit = seen == pair
            out[todo[hit]] = self.ranks[at[hit]]
            rest = np.flatnonzero(~hit & (seen >= 0))
            if not len(rest):
                break
            todo, pair, at = todo[rest], pair[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the bytes of both tokens together encode to just these two, for each pair."""
        pair = left << 32 | right
        at = _mixed(pair, TABLE_BITS)
        out = self.fits[at]
        new = np.flatnonzero(self.pairs[at] != pair)
        if len(new):
            asked, inverse = np.unique(pair[new], return_inverse=True)
            found = self._lasting(asked >> 32, asked & 0xFFFFFFFF)
            out[new] = found[inverse]
            slot = _mixed(asked, TABLE_BITS)
            self.pairs[slot] = asked
            # of several pairs in one place the one that was written last stays, with its own answer
            stays = self.pairs[slot] == asked
            self.fits[slot[stays]] = found[stays]
        return out

    def _lasting(self, left: np.ndarray, right: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether the seam between two tokens lasts while their bytes are merged.

        Undo the merges of both tokens from the last to the first. At each moment the parts that face each other across
        the seam existed side by side; if their own merge has a rank below every merge undone so far (the left side
        wins ties, as merging runs from the left), it would have come first and the seam would not have lasted.
        own: the rank of the two tokens' own merge, if that one doesn't count against them."""
        out = np.zeros(len(left), bool)
        todo, left, right = np.arange(len(left)), left.copy(), right.copy()
        # limits are doubled; an odd limit lets an equal rank pass on the right side
        limit = np.full(len(left), 1 << 60, np.int64)
        while len(todo):
            across = self.rank(left, right)
            against = (across >= 0) & (2 * across < limit)
            if own is not None:
                against &= across != own[todo]
            a, b = self.made[left], self.made[right]
            ended = (a < 0) & (b < 0)
            out[todo[ended & ~against]] = True
            go = np.flatnonzero(~against & ~ended)
            todo, left, right, a, b = todo[go], left[go], right[go], a[go], b[go]
            # of equal merges on both sides the left one is applied first, so the right one is undone first
            on_left = a > b
            limit = np.where(on_left, 2 * a, 2 * b + 1)
            left, right = np.where(on_left, self.right[left], left), np.where(on_left, right, self.left[right])
        return out

    def _sound(self) -> np.ndarray:
        """For each token, whether merging its own bytes gives the token: its last merge joins two sound, compatible
        parts. Parts have earlier merges, so they are known before the whole."""
        sound = self.length == 1
        whole = np.flatnonzero(self.made >= 0)
        whole = whole[np.argsort(self.made[whole], kind="stable")]
        joins = self._lasting(self.left[whole], self.right[whole], self.made[whole])
        for t, a, b, ok in zip(whole.tolist(), self.left[whole].tolist(), self.right[whole].tolist(), joins.tolist(), strict=True):
            sound[t] = ok and sound[a] and sound[b]
        return sound

    def encode_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each); piece i is data[offsets[i] : offsets[i + 1]]."""
        longest = self.automaton.longest(data, offsets)
        ending = np.full(len(data) + 1, -1, np.int64)  # the token of the path so far that ends at a place
        dead = np.zeros(len(data) + 1, bool)
        chosen = np.full(len(data), -1, np.int64)  # by its first byte, each token of the result
        piece = np.flatnonzero(offsets[1:] > offsets[:-1])
        at = offsets[piece]
        token, before = longest[at].astype(np.int64), np.full(len(piece), -1, np.int64)
        while len(piece) > FEW:
            back = token < 0
            if back.any():  # nothing fits here: give up this place and shorten the token before
                i = np.flatnonzero(back)
                dead[at[i]] = True
                at[i] -= self.length[before[i]]
                token[i] = self.shorter[before[i]]
                before[i] = np.where(at[i] > offsets[piece[i]], ending[at[i]], -1)
            end = at + self.length[token]
            ok = (token >= 0) & ~dead[end] & self.sound[token]
            i = np.flatnonzero(ok & (before >= 0))
            ok[i] = self.compatible(before[i], token[i])
            failed = np.flatnonzero(~ok & (token >= 0))
            token[failed] = self.shorter[token[failed]]
            i = np.flatnonzero(ok)
            ending[end[i]] = token[i]
            before[i], at[i] = token[i], end[i]
            token[i] = longest[end[i]]
            left = np.flatnonzero(at < offsets[piece + 1])
            if len(left) < len(piece):
                self._path(piece[at == offsets[piece + 1]], offsets, ending, chosen)
                piece, at, token, before = piece[left], at[left], token[left], before[left]
        for i in piece.tolist():
            a, b = int(offsets[i]), int(offsets[i + 1])
            for place, found in self._backtracked(longest[a:b].tolist()):
                chosen[a + place] = found
        taken = chosen >= 0
        return chosen[taken].astype(np.uint32), np.diff(np.r_[0, np.cumsum(taken)][offsets])

    def _path(self, piece: np.ndarray, offsets: np.ndarray, ending: np.ndarray, chosen: np.ndarray) -> None:
        """Notes the tokens of finished pieces, from the last to the first."""
        at, first = offsets[piece + 1], offsets[piece]
        while len(at):
            token = ending[at]
            at = at - self.length[token]
            chosen[at] = token
            left = at > first
            at, first = at[left], first[left]

    def _backtracked(self, longest: list[int]) -> list[tuple[int, int]]:
        """(place, token) of one piece: the same search with the path as a list."""
        stop, length, sound = len(longest), self.length, self.sound
        dead, path = bytearray(stop + 1), []
        at, token = 0, longest[0]
        known: dict[tuple[int, int], bool] = {}
        while True:
            end = at + int(length[token])
            if not dead[end] and sound[token]:
                ok = not path
                if path:
                    pair = path[-1][1], token
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = bool(self.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                if ok:
                    path.append((at, token))
                    if end == stop:
                        return path
                    at, token = end, longest[end]
                    continue
            token = int(self.shorter[token])
            while token < 0:
                dead[at] = 1
                at, before = path.pop()
                token = int(self.shorter[before])

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them); a null text has no ids, a special token's string gives its id."""
        pieces = cut(texts, self.special)
        pool, size = self.encode_pieces(pieces.data, pieces.offsets)
        if pieces.special:
            first = np.cumsum(size) - size
            cuts = np.split(pool, first[1:]) if len(size) else []
            for k, token in pieces.special.items():
                cuts[k] = np.array([token], np.uint32)
            pool, size = np.concatenate(cuts), np.array([len(x) for x in cuts], np.int64)
        return spread(pieces, pool, size)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_texts(pa.array([text], pa.string()))[0]

    def gather(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' bytes one after another, and for each token (and the end) the number of bytes before it."""
        start = self.offsets[tokens]
        size = self.offsets[tokens.astype(np.int64) + 1] - start
        before = np.r_[0, np.cumsum(size)]
        return gathered(self.blob, start, size, before[1:]), before

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes; bytes that are no UTF-8 become U+FFFD."""
        return valid_utf8(self.gather(ids)[0].tobytes())


def valid_utf8(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def _coded(path: str, with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in by_bytes(batches, TOGETHER):
            ids, ends = c.encode_texts(batch.column(1))
            starts = np.r_[0, ends[:-1]] if len(ends) else ends
            raw, bytes_before = c.gather(ids)
            n, ids_sha, text_sha, lists, texts = [], [], [], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                own = ids[a:b]
                back = valid_utf8(raw[bytes_before[a] : bytes_before[b]].tobytes())
                n.append(b - a)
                ids_sha.append(hashlib.sha256(own).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                if with_content:
                    lists.append(own.astype(np.int32))
                    texts.append(back.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_content:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names=names)
            pa.default_memory_pool().release_unused()

    return run


def encode_decode(docs: DataFrame, tokenizer: str, with_content: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): digests of ids and decoded text, and with
    ``with_content`` the ids and the text themselves.

    A null text counts as empty: no ids, digests of nothing. Whole texts of any length are encoded; repeated rows give
    repeated results; an empty table gives no rows. ``tokenizer`` is a path that every executor can open.
    """
    small_batches(docs.sparkSession)
    more = ", ids array<int>, decoded string" if with_content else ""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _coded(tokenizer, with_content),
        f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}",
    )
