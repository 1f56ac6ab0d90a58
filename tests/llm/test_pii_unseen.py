"""Contexts where many identifiers are unseen."""

from palimpsest.llm import pii


def test_pii_contexts_with_many_unseen(spark):
    seeds = [f"mail me at reader{i}@mail.example.com soon" for i in range(6)]
    half = [f"mail me at jane{i}(at)mail.example.com soon" for i in range(6)]
    calls = [f"please then dial +1 (200) 555-{1000 + i} again" for i in range(8)] + [f"please then dial 200-555-{2000 + i} again" for i in range(4)]
    # numbers that no kind's form fits speak against a context, and so do seeds of another kind
    mixed = [f"found under entry who{i}@mail.example.com there" for i in range(6)] + [f"found under entry {1000 + i} there" for i in range(6)] + ["found under entry who(at)mail.example.com there"]
    kinds = [f"noted as being x{i}@mail.example.com or" for i in range(5)] + [f"noted as being +1 (300) 555-{1000 + i} or" for i in range(5)] + ["noted as being y(at)mail.example.com or"]
    texts = [*seeds, *half, *calls, *mixed, *kinds]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {texts[r.doc_id]: [s.kind for s in r.added] for r in pii.find_pii(docs).collect() if r.added}
    assert added == {t: ["email"] for t in half} | {t: ["phone"] for t in calls[8:]}
