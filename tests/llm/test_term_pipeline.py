import math
import re
from collections import Counter

import pytest

from corpusgraph.llm import term_pipeline

from .conftest import BASE, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, BASE), (2, "W7919 w1; the-lazy ünï A a"), (3, None), (4, ""), (5, "nothing2find"), (None, "b id"), (6, "É cödé x"), (6, "jugs"), (7, "a " * 500)]


def terms(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, words = len(counted), sum(n for *_, n in counted)
    df = Counter(x for _, c, _ in counted for x in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        found = []
        for d, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 20 * m)) for x in asked if c[x])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, owners, shard, bundle, listed", [(50, 3, 2048, 256, 200_000), (3, 1, 4, 2, 200_000), (5, 5, 3, 1, 2)])
def test_equals_brute_force(spark, odd, monkeypatch, k, owners, shard, bundle, listed):
    for name, value in (("SHARD_DOCS", shard), ("BUNDLE", bundle), ("LISTED_TERMS", listed)):
        monkeypatch.setattr(term_pipeline, name, value)
    items = spark.createDataFrame([(*r, 1, "x") for r in ITEMS], "item_id long, text string, shard long, term string")
    found = term_pipeline.search(odd.repartition(3), items, k, owners=owners).collect()
    want = brute([r[:2] for r in odd_rows()], ITEMS, k)
    assert sorted((tuple(r) for r in found), key=str) == want


def test_terms_are_those_of_the_pattern():
    for text in ("", "A-b_c9 Ünï x y", "a\x00b\x7fC", "日本 語。A"):
        assert [t.decode() for t in term_pipeline.terms(text.encode())] == terms(text)


def test_empty(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert term_pipeline.search(empty, items).count() == 0
    assert term_pipeline.search(odd, items.where("false")).count() == 0
