"""Files with many notices keep all their labels."""

import itertools
import random

from palimpsest.llm import license_scan


def test_license_file_with_all_templates(spark):
    notices = [t for t, _ in license_scan.TEMPLATES.values()]
    rows = [(0, " . ".join(notices)), (1, " . ".join(reversed(notices)))]
    four = ["mit-text", "bsd", "gpl", "mpl-2"]
    rows += [(2 + i, " and then ".join(license_scan.TEMPLATES[k][0] for k in order)) for i, order in enumerate(itertools.permutations(four))]
    rows += [(100 + i, t) for i, t in enumerate(notices)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan_licenses(docs).collect()}
    assert found[0] >= set(license_scan.TEMPLATES) and found[1] >= set(license_scan.TEMPLATES)
    assert all(found[2 + i] >= set(four) for i in range(24))
    for i, label in enumerate(license_scan.TEMPLATES):
        assert label in found[100 + i]


def test_license_index_against_all_offsets():
    rnd = random.Random(3)
    known = [w for w in license_scan.vocabulary()]
    index = license_scan.Index({b"": 500} | {w: rnd.randint(0, 400) for w in known})
    for _ in range(60):
        words = []
        for label in rnd.choices(list(index.templates), k=12):
            words += [w if rnd.random() > 0.15 else rnd.choice(known) for w in index.templates[label]]
        expected = {}
        for label, template in index.templates.items():
            for offset in range(-len(template), len(words)):
                part = words[max(0, offset) : max(0, offset + len(template))]
                share = sum(index.idf[w] for k, w in enumerate(template) if 0 <= offset + k < len(words) and words[offset + k] == w) / index.weight[label]
                holds = all(any(tuple(part[k : k + len(p)]) == p for k in range(len(part))) for p in index.required[label])
                if share >= license_scan.MIN_SHARE and holds:
                    expected[label] = max(expected.get(label, 0), share)
        assert index.scan(words)[1] == expected
