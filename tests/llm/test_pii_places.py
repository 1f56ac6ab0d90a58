"""Contexts and identifier-like places against plain definitions, without limits on length."""

import random
import re

from palimpsest.llm import pii


def plain_patterns(text, a, b):
    before, after = text[:a].lower().split()[-2:], text[b:].lower().split()[:1]
    found = ["<< " + " ".join(before)] if len(before) == 2 else []
    return found + ([f"< {before[-1]} > {after[0]}"] if before and after else [])


def test_contexts_are_whole_words():
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "Bc", " ", "  ", "\n", "x" * 200, "1", ":"]) for _ in range(rnd.randint(0, 25)))
        words = [m.span() for m in re.finditer(r"\S+", text)]
        for _ in range(5):
            a = rnd.randint(0, len(text))
            b = rnd.randint(a, len(text))
            assert pii._patterns(text, a, b, words) == plain_patterns(text, a, b), (text, a, b)


def test_long_identifiers_stay_whole():
    long = "0 " * 60 + "1"
    name = "n" * 300
    assert pii._like(f"id {long} end") == [(3, 3 + len(long))]
    assert pii._like(f"to {name}(at)host.example now") == [(3, 3 + len(f"{name}(at)host.example"))]
    assert pii._like("1234567(at)x.y and (555) 12-34.") == [(0, 14), (19, 30)]
    assert pii._like("12 - (1) no") == [] and pii._like("(" * 100_000 + "-" * 100_000) == []
