import random
from itertools import combinations

import xxhash

from corpusgraph.llm import simhash

from .conftest import odd_rows


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: id -> fingerprint."""
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in prints}


def test_fingerprint_matches_definition():
    for r in odd_rows():
        assert simhash.fingerprint((r[1] or "").encode()) == slow_print(r[1])


def test_query_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    prints = {r[0]: slow_print(r[1]) for r in odd_rows() if r[0] is not None}
    want = slow_components(prints)
    for r in rows:
        if r.id is not None:
            assert r.fp % 2**64 == prints[r.id] and r.component_id == want[r.id]
        else:
            assert r.component_id is None
    assert simhash.near_duplicates(empty).count() == 0


def test_links_lose_no_pair_in_hot_entries(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {i: centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for i in range(700)}
    prints |= {1000 + i: rng.getrandbits(64) for i in range(300)}
    first = {}
    for i, p in prints.items():
        first.setdefault(p, i)
    want = slow_components({i: p for p, i in first.items()})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for p, i in first.items()], "fp long, node long")
    for block in (64, 4096):
        got = {r.node: r.component for r in simhash.components(simhash.links(nodes, block)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_one_of_each(odd):
    kept = simhash.one_of_each(odd)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    found = simhash.near_duplicates(odd).collect()
    assert sorted(set(ids)) == sorted({r.component_id for r in found if r.component_id is not None})
    assert kept.where("doc_id is null").count() == 1 and kept.columns == odd.columns
