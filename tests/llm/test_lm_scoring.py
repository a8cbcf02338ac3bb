import math
import random
import zlib
from collections import Counter

import numpy as np

from corpusgraph.llm import lm_scoring as lm

from .conftest import odd_rows


def slow_mix(d, tables, weights, apm):
    """One segment after another, one bit after another."""
    x, gate = lm._inputs(d, tables, False)
    out = []
    for start, length in zip(d["start"], d["length"]):
        w, a, cost = weights.astype(np.float64).copy(), apm.astype(np.float64).copy(), 0.0
        for i in range(start, start + length):
            z = min(14, max(-14, float(w[gate[i]] @ x[i])))
            p, k = 1 / (1 + math.exp(-z)), int((z + 14) * (lm.APM_STEPS - 1) / 28 + 0.5)
            y = int(d["y"][i])
            mixed = (p + a[k]) / 2
            cost -= math.log2(mixed if y else 1 - mixed)
            w[gate[i]] += lm.RATE * (y - p) * x[i]
            a[k] += lm.APM_RATE * (y - a[k])
        out.append(cost)
    return np.array(out)


def test_mixing_equals_bit_by_bit():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() for _ in range(40)] + [b""]
    d = lm.spelling_bits(words)
    tables = [np.bincount(2 * s + d["y"], minlength=2 * lm.SPELL_SLOTS).reshape(-1, 2).astype(np.uint32) for s in d["slots"]]
    w, a = lm.fresh()
    for t in (tables, [lm.packed(x) for x in tables]):
        assert np.allclose(lm.mix_bits(d, t, w, a), slow_mix(d, t, w, a), rtol=1e-3)


def test_side_by_side_equals_one_by_one():
    rng = np.random.default_rng(5)
    length = np.array([40, 3, 0, 900, 40, 41, 1, 300, 7])
    n, start = int(length.sum()), np.cumsum(length) - length
    x, gate, y = rng.normal(size=(n, 4)).astype(np.float32), rng.integers(0, 3, n), rng.integers(0, 2, n)
    w, a = np.full((3, 4), 0.3), lm.fresh()[1]
    got = lm.mixed(x, gate, y, start, length, w, a)
    slow = [lm._one_by_one(x[i : i + k].tolist(), gate[i : i + k].tolist(), y[i : i + k].tolist(), w.tolist(), a.tolist()) for i, k in zip(start, length)]
    assert np.allclose(got, slow, rtol=1e-3, atol=1e-3) and got[2] == 0


def slow_said(symbol, own, three, two, leave_out):
    """What a token's contexts say of it, from counters of the tokens that follow them."""
    lists, states = [], []
    for c in (Counter(three), Counter(two)):
        if leave_out and own:
            c[symbol] -= 1
        ranked = sorted((k for k in c if c[k] > 0), key=lambda k: (-c[k], k != symbol if leave_out else 0, k))
        total = sum(c.values())
        states.append(5 * min(total.bit_length(), 6) - 4 + sum(c[ranked[0]] / total >= t for t in (0.25, 0.5, 0.75, 1)) if ranked else 0)
        lists.append(ranked)
    asked = list(dict.fromkeys(lists[0][:1] + lists[1][:3]))
    agree = int(bool(lists[0]) and lists[0][0] == lists[1][0])
    return states[0], agree, max(0, len(asked) - 1), states[1], asked.index(symbol) + 1 if symbol in asked else 0


def told(rows, leave_out):
    """The numbers of slow_said for every token of (held out, words), by brute force."""
    three, two = {}, {}
    lines = [(out, [(["$", "$", "$", *w, "."][i : i + 3], t) for i, t in enumerate([*w, "."])]) for out, w in rows]
    number = {t: int(h) for t, h in zip(*symbols([w for _, w in rows]))}
    for out, line in lines:
        for (a, b, c), t in line:
            if not out:
                three.setdefault((a, b, c), Counter())[number[t]] += 1
                two.setdefault((b, c), Counter())[number[t]] += 1
    return [[slow_said(number[t], not out, three.get((a, b, c), {}), two.get((b, c), {}), leave_out) for (a, b, c), t in line] for out, line in lines]


def symbols(texts):
    words = lm.Words([" ".join(w).encode() for w in texts])
    c = lm.Contexts(words, 40, np.zeros(0, np.uint64))
    return [t for w in texts for t in [*w, "."]], c.symbol


def random_rows(n=60, seed=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    line = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
        rows.append((i % 5 == 0, w + line[: rng.randrange(40)] if i % 3 == 0 else w))
    return rows


def test_shards_say_what_counters_say():
    rows = random_rows()
    chunks = [rows[i : i + 17] for i in range(0, len(rows), 17)]
    made, blobs = [], []
    for part in chunks:
        words = lm.Words([" ".join(w).encode() for _, w in part])
        c = lm.Contexts(words, 40, np.zeros(0, np.uint64))
        first = c.order[c.records]
        n = np.bincount(c.own, weights=np.repeat([not out for out, _ in part], words.sizes), minlength=len(first)).astype(np.int64)
        made.append((words, c))
        blobs.append((c.of[first], c.symbol[first], n))
    found = lm.answers(blobs)
    for leave_out in (False, True):
        want = told(rows, leave_out)
        for k, (words, c) in enumerate(made):
            said = found[k][2 * leave_out : 2 * leave_out + 2, c.own]
            got = np.stack([said[0] & 31, said[0] >> 5 & 1, said[0] >> 6, said[1] & 31, said[1] >> 5], axis=1).tolist()
            flat = [list(x) for line in want[17 * k : 17 * k + 17] for x in line]
            train = np.repeat([not out or not leave_out for out, _ in chunks[k]], words.sizes)
            assert [g for g, t in zip(got, train) if t] == [w for w, t in zip(flat, train) if t]


def slow_score(rows, vocabulary_free=True):
    """The whole score, token by token, where every word is known. rows: (id, held out, words)."""
    plain, left = told([r[1:] for r in rows], False), told([r[1:] for r in rows], True)

    def questions(line):
        run, out = 0, []
        for three, agree, more, two, outcome in line:
            for k in range(outcome or (more + 1 if two else 0)):
                kind = 3 if k else 0 if not three else 1 if agree else 2
                state = k + 4 * (three > 0) if k else three
                out.append((run * lm.CELLS + kind * 1024 + state * 32 + two, run * 4 + kind, outcome == k + 1))
            run = min(run + 1, 3) if outcome == 1 else 0
        return out

    hits, seen = np.zeros(lm.RUNS * lm.CELLS), np.zeros(lm.RUNS * lm.CELLS)
    for (_, out, _), line in zip(rows, left):
        for cell, _, y in questions(line) if not out else []:
            hits[cell] += y
            seen[cell] += 1
    x = lm.predictors(hits, seen)
    counts = Counter(t for _, out, w in rows if not out for t in [*w, "."])
    n, docs = sum(counts.values()), sum(not out for _, out, _ in rows)
    novel = min(0.5, max(1e-3, sum(v == 1 for k, v in counts.items() if k != ".") / n))
    alike, of = Counter(), {t: int(h) for t, h in zip(*symbols([w for *_, w in rows]))}
    for t, c in counts.items():
        alike[of[t]] += c + (t == ".")
    found = []
    for (_, _, w), line in zip(rows, plain):
        asked = questions(line)
        cost = lm._one_by_one([x[c].tolist() for c, _, _ in asked], [g for _, g, _ in asked], [int(y) for _, _, y in asked], [list(lm.START_WEIGHTS) for _ in range(16)], lm.fresh()[1].tolist())
        total = -cost * math.log10(2)
        for t, (*_, outcome) in zip([*w, "."], line):
            total += math.log10((docs + 1 if t == "." else counts[t]) * (1 - novel) / (alike[of[t]] if outcome else n + 1))
        found.append(total)
    return found


def test_whole_score_equals_the_slow_one(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, held(i), w) for i, (_, w) in enumerate(random_rows(150, 3))]
    want = slow_score(rows)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, _, w in rows], "doc_id long, text string").repartition(4)
    for size, shard in ((1 << 17, 1 << 21), (5, 300)):
        got = {r.doc_id: r.score for r in lm.score(docs, vocabulary_size=size, shard=shard).collect()}
        assert np.allclose([got[i] for i, _, _ in rows], want, rtol=2e-3, atol=1e-2)


def test_frequent_pairs_take_one_word_more(spark):
    rows = [(i, " ".join(w)) for i, (_, w) in enumerate(random_rows(200, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.score(docs, frequent_from=3).collect()
    same(found, rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def slow_base(rows):
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))) for i, t in rows]


def same(found, rows):
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score) for r in found)
    want = sorted(((str(i), *x[:4]), x[4]) for i, *x in slow_base(rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])


def test_odd_rows(odd, empty):
    rows = [r[:2] for r in odd_rows()]
    for size in (1 << 17, 20):
        found = lm.score(odd, vocabulary_size=size).collect()
        same(found, rows)
        assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert lm.score(empty).count() == 0


def test_learns_the_language(spark):
    rng = random.Random(8)
    follow = {f"w{i}": [f"w{(i * 7 + k) % 60}" for k in range(3)] for i in range(60)}
    rows = []
    for i in range(600):
        w = ["w1"]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    found = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(found, rows)
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > 0.45 * sum(r.base_score for r in out)
    shuffled = [(i, " ".join(rng.sample(t.split(), 61))) for i, t in rows]
    worse = [r for r in lm.score(spark.createDataFrame(shuffled, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in worse) < sum(r.score for r in out)


def test_an_unseen_word_of_the_expected_bits_is_spelled(spark):
    """Two words that no training text has cost alike, though one shares the expected word's 16 bits."""
    import xxhash

    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(200, 400) if not zlib.crc32(str(i).encode()) % 10][:2]
    bits = lambda w: xxhash.xxh3_64_intdigest(w.encode()) & 0xFFFF
    twin, index, n = None, {}, 0
    while twin is None:
        word = f"w{n:05d}"
        if bits(word) in index:
            expected, twin = index[bits(word)], word
        index[bits(word)], n = word, n + 1
    other = next(f"w{k:05d}" for k in range(n + 1, n + 50) if bits(f"w{k:05d}") != bits(twin))
    rows = [(i, f"alpha beta gamma {expected} tail") for i in train[:100]]
    rows += [(held[0], f"alpha beta gamma {twin} tail"), (held[1], f"alpha beta gamma {other} tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm.score(df).where("held_out").collect()}
    # the other word pays for the missed expectation too, and no word of the expected bits is free
    assert max(score.values()) < -15 and 0 <= score[held[0]] - score[held[1]] < 8
    seen = lm.score(df).where("NOT held_out").first()
    assert -1 < seen.score <= 0


def test_every_rare_word_teaches_spelling(spark, monkeypatch):
    """More words than the former sample of 30,000: the start weights of spelling come from all of them."""
    taught, learned = set(), lm._learned

    def watched(rows, *rest):
        taught.update(bytes(r[0]).decode() for r in rows.select("word").collect())
        return learned(rows, *rest)

    monkeypatch.setattr(lm, "_learned", watched)
    rows = [(i, " ".join(f"w{1000 * i + k}" for k in range(1000))) for i in range(50)]
    found = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_size=10).collect()
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert taught == {w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split()} and len(taught) > 30_000


def test_spelling_learns_as_from_counts_without_one():
    """Log-odds looked up by slot and bit are those of counts without the decision's own occurrence."""
    words = [b"a", b"ab", b"abc", b"abd", b"zz", "ü☃".encode()] * 3
    d = lm.spelling_bits(words)
    tables = [np.bincount(2 * s + d["y"], minlength=2 * lm.SPELL_SLOTS).reshape(-1, 2).astype(np.uint32) for s in d["slots"]]
    want, got = lm._inputs(d, tables, True), lm._inputs(d, [lm.left_out(t) for t in tables], False)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
