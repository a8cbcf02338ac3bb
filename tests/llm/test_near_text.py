import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from corpusgraph.llm import near_text, simhash

from .conftest import odd_rows


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def slow_components(texts):
    """texts: id -> text; the smallest id reachable by pairs of five-word Jaccard 0.8 or more."""
    sets, part = {i: slow_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if part[a] != part[b] and (len(x & y) / len(x | y) if x or y else 1) >= 0.8:
            low, high = sorted((part[a], part[b]))
            part = {i: low if p == high else p for i, p in part.items()}
    return part


def edited_rows():
    """Families of texts with growing numbers of changed words, so that links, chains and misses occur."""
    rng, rows = random.Random(4), []
    for family in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 200, 900]))]
        for k in range(9):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            for _ in range(1 + len(base) * k // 300):
                base[rng.randrange(len(base))] = f"e{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def test_stage_keeps_one_of_edited_copies(spark):
    rows = edited_rows()
    want = slow_components(dict(rows))
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    prints = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    far = [(a, b) for a, b in combinations(prints, 2) if want[a] == want[b] and (prints[a] ^ prints[b]).bit_count() > 3]
    assert far and len(set(want.values())) > 12


def test_blocks_lose_no_pair(spark):
    rows = edited_rows()
    want = slow_components(dict(rows))
    docs = spark.createDataFrame(rows, "id long, text string")
    nodes = spark.createDataFrame([(i, near_text.min_values(near_text.shingle_set(t.encode())).tobytes()) for i, t in rows], "node long, print binary")
    got = {r.node: r.component for r in simhash.components(near_text.links(docs, nodes, block=3)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_odd_rows(odd, empty):
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    want = slow_components(texts)
    found = near_text.near_copies(odd).collect()
    assert len(found) == len(odd_rows())
    assert all(r.component_id == (None if r.id is None else want[r.id]) for r in found)
    kept = near_text.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert near_text.one_of_each(empty).count() == 0


def test_simhash_index_finds_pairs_by_itself(spark):
    """Documents that meet at no position of smallest values, but within three bits of SimHash, are tried in both rounds."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    texts = {1: "quite another text of ten words that only shares bytes", 2: " ".join(base), 3: " ".join([*base[:-1], "edited"])}
    h = np.array([simhash.fingerprint(texts[2].encode(), words=5)], "<u8")
    prints = {1: h, 2: h, 3: h ^ np.uint64(0b101)}  # the first round tries 1 against 2 and 3 only
    values = np.random.default_rng(1).integers(0, 1 << 16, (4, near_text.HASHES)).astype("<u2")
    nodes = spark.createDataFrame([(i, values[i].tobytes() + prints[i].tobytes()) for i in texts], "node long, print binary")
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert [(r.a, r.b) for r in near_text.links(docs, nodes).collect()] == [(2, 3)]


def test_print_ends_in_the_simhash_of_five_words():
    text = " ".join(f"w{k}" for k in range(100)).encode()
    assert near_text.min_values(near_text.shingle_set(text))[near_text.HASHES :].tobytes() == simhash.fingerprint(text, words=5).to_bytes(8, "little")
