import hashlib
import random

import numpy as np
import pytest

from corpusgraph.llm import suffix_dedup as sd

from .conftest import odd_rows


def slow(rows, length):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_repeats(n=120):
    rng = random.Random(6)
    words = lambda k: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(k))
    passages = [words(90) for _ in range(4)]
    rows = []
    for i in range(n):
        text = words(rng.randrange(0, 120))
        if i % 3 == 0:
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            text += (p if i % 2 else p[a:b]) + words(rng.randrange(0, 60))
        if i % 10 == 5:
            text = rows[rng.randrange(len(rows))][1] + "!" * (i % 2)
        rows.append((i, text))
    return rows + [(900, "ab" * 400), (901, "z" * 199), (902, "z" * 200), (903, "q" * 201), (904, "q" * 100), (3, rows[3][1])]


def test_suffix_array_and_merge():
    rng = np.random.default_rng(1)
    shards = [np.concatenate([rng.integers(1, 4, n), [0]]).astype(np.uint16) for n in (50, 80, 3, 120)]
    for s in shards:
        order = sd.suffix_array(s, 300)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    depth = 6
    starts = [np.arange(len(s) - depth) for s in shards if len(s) > depth]
    shards = [s for s in shards if len(s) > depth]
    place, block, _ = sd.merged_blocks(shards, depth, starts)
    flat, base = np.concatenate(shards), np.cumsum([0, *map(len, shards)])
    grams = {}
    for s, at, o in zip(shards, starts, base):
        for i in at.tolist():
            grams.setdefault(tuple(s[i : i + depth].tolist()), set()).add(i + int(o))
    assert sorted(place.tolist()) == sorted(i for g in grams.values() if len(g) > 1 for i in g)
    prefixes = [tuple(flat[i : i + depth].tolist()) for i in place]
    assert prefixes == sorted(prefixes)
    assert (np.diff(block) > 0).tolist() == [a != b for a, b in zip(prefixes, prefixes[1:])]


def cores(text):
    """Each window's text and what its piece is filed under."""
    first, last, low, high = sd.pieces(text)
    assert (first >= low).all() and (last <= high).all() and (first <= last).all()
    whole = sorted(zip(first.tolist(), last.tolist()))
    assert not text[199:] or whole[0][0] == 0 and whole[-1][1] == len(text) - 200 and all(b[0] == a[1] + 1 for a, b in zip(whole, whole[1:]))
    return [(text[i : i + 200], text[h : w + 200]) for a, b, w, h in zip(first, last, low, high) for i in range(a, b + 1)]


def test_equal_windows_have_equal_cores():
    text = random.Random(1).randbytes(3000)
    other = b"xyz" * 50 + text[500:1500] + b"abc" * 70
    own = dict(cores(text))
    found = cores(other)
    assert sum(w in own for w, _ in found) == 801
    assert all(own.get(w, c) == c and c in w and len(c) >= 116 for w, c in found)
    assert not cores(b"z" * 199) and len(cores(b"z" * 200)) == 1


def test_long_texts_are_cut_into_strides(monkeypatch):
    text = random.Random(2).randbytes(5000)
    want = sd.anchors(text)
    monkeypatch.setattr(sd, "_STRIDE", 300)
    assert (sd.anchors(text) == want).all()
    grams = sd._gram_hashes(text, 32) >> np.uint64(20)
    assert all(want[i] == i + int(np.argmin(grams[i : i + 169])) for i in range(len(want)))


def test_common_suffixes():
    """A window's number of last symbols that another window also ends with."""
    rng = np.random.default_rng(4)
    depth = 7
    shards = [np.concatenate([rng.integers(1, 3, n), [0]]).astype(np.uint16) for n in (40, 60)]
    starts = [np.arange(len(s) - depth) for s in shards]
    place, _, common = sd.merged_blocks(shards, depth, starts)
    windows = [(i + o, s[i : i + depth].tolist()[::-1]) for s, at, o in zip(shards, starts, (0, len(shards[0]))) for i in at]
    for i, w in windows:
        best = max(next((k for k in range(depth) if w[k] != v[k]), depth) for j, v in windows if j != i)
        assert common[i] == best
    assert (common == depth).sum() == len(place)


@pytest.mark.parametrize("group", [500, 20, 1])
def test_equals_brute_force(spark, group):
    rows = rows_with_repeats()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sd.remove_repeats(docs, group=group, keep_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == slow(rows, 200)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_small_shards(spark):
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 90))) for _ in range(40)]
    seen = {}
    for p in pieces:
        for i in range(len(p) - 15):
            seen[p[i : i + 16]] = seen.get(p[i : i + 16], 0) + 1
    for shard in (64, 500, 1 << 20):
        got = sd.repeated_windows(pieces, 16, shard)
        assert [g.tolist() for g in got] == [[seen[p[i : i + 16]] > 1 for i in range(len(p) - 15)] for p in pieces]


def test_odd_rows(odd, empty):
    got = sd.remove_repeats(odd).collect()
    rows = [r[:2] for r in odd_rows()]
    long = {r[0]: r[1] for r in rows if r[1] and len(r[1]) > 50_000}
    want = {(x[0], *x[1:]) for x in slow([(i, t) for i, t in rows if i not in long], 200)}
    assert {tuple(r) for r in got if r.doc_id not in long} == want and len(got) == len(rows)
    assert {r.n_removed for r in got if r.doc_id in long} == {len(t.encode()) - (t.endswith(" z")) for t in long.values()}
    assert sd.remove_repeats(empty).count() == 0
