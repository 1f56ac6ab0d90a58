"""Pieces against the split of the tokenizers library, on all its classes of characters."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from palimpsest.llm import bpe, pieces, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "1", "²", "!", ".", "é", "日", "　", "\x85", "🎉", "'s", "'ll", "\x00"]


def cut(texts):
    p = pieces.cut(pa.array(texts, pa.string()), {})
    names = [bytes(p.data[a:b]).decode() for a, b in zip(p.offsets, p.offsets[1:], strict=False)]
    assert len(set(names)) == len(names)
    return [[names[k] for k in p.code[a:b]] for a, b in zip([0, *p.ends], p.ends, strict=False)]


def test_pieces_are_the_librarys():
    split, rnd = Tokenizer.from_file(PATH).pre_tokenizer, random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    assert cut(texts) == [[t[a:b] for _, (a, b) in split.pre_tokenize_str(t)] for t in texts]


def test_classes_are_the_librarys():
    split = Tokenizer.from_file(PATH).pre_tokenizer
    points = [c for a in (0, 0x1680, 0x2000, 0x3000, 0xA7C0, 0x10D40, 0x1E5C0, 0x1E6C0, 0x323A0) for c in range(a, a + 0x300)]
    texts = [f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}! " for c in points]
    assert cut(texts) == [[t[a:b] for _, (a, b) in split.pre_tokenize_str(t)] for t in texts]


def test_both_encoders_agree_with_the_library():
    t, rnd = Tokenizer.from_file(PATH), random.Random(2)
    texts = ["".join(rnd.choice([*PARTS, "<|endoftext|>", "th", "ing"]) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += [None, "", "x" * 20_000, "=-" * 900, "".join(rnd.choice("abcdefghij") for _ in range(9000))]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéö") for _ in range(rnd.randint(1, 20))) for _ in range(3000)]
    expected = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for encode in (bpe.codec(PATH).encode_texts, token_store.library_encoder(PATH)):
        for limit in (len(texts), 7):
            for k in range(0, len(texts) if limit > 7 else 70, limit):
                ids, ends = encode(pa.array(texts[k : k + limit], pa.string()))
                assert [ids[a:b].tolist() for a, b in zip(np.r_[0, ends], ends, strict=False)] == expected[k : k + limit]
        assert len(encode(pa.array([], pa.string()))[0]) == 0


def test_batches_by_bytes():
    rows = pa.record_batch([pa.array(range(9)), pa.array(["x" * n for n in (0, 5, 50, 1, 1, 1, 0, 20, 3)])], names=["i", "t"])
    got = list(pieces.by_bytes(iter([rows.slice(0, 4), rows.slice(4, 0), rows.slice(4)]), 10))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(9))
    assert [[len(t) for t in b.column(1).to_pylist()] for b in got] == [[0, 5], [50], [1, 1, 1, 0], [20], [3]]
