import itertools
import random

import numpy as np

from corpusgraph.llm import toxicity

from .conftest import odd_rows


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    t = rng.normal(size=(3, 2))
    sizes = [5, 1, 3]
    e = rng.normal(size=(3, 5))
    real = np.arange(5)[None, :] < np.array(sizes)[:, None]
    m, expected = toxicity.forward_backward(e, real, t, True)
    pairs = np.zeros((3, 2))
    for row, n in enumerate(sizes):
        total, ones, own = 0.0, np.zeros(n), np.zeros((3, 2))
        for tags in itertools.product((0, 1), repeat=n):
            s = t[2, tags[0]] + sum(e[row, i] for i in range(n) if tags[i]) + sum(t[a, b] for a, b in zip(tags, tags[1:]))
            p = np.exp(s)
            total += p
            ones += p * np.array(tags)
            own[2, tags[0]] += p
            for a, b in zip(tags, tags[1:]):
                own[a, b] += p
        assert np.allclose(m[row, :n], ones / total)
        pairs += own / total
    assert np.allclose(expected, pairs)


def test_windows_cover_each_word_once():
    sizes = np.array([0, 3, 64, 65, 0, 200])
    at, real = toxicity._windows(sizes)
    assert sorted(at[real].tolist()) == list(range(332))


def corpus(n=900):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(["vilebad", "Nastyword,", "rotten"]))
        rows.append((i, " ".join(body), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.judge(docs, given).collect()
    truth = {i: t for i, _, t in labels}
    out = [r for r in found if r.held_out]
    assert len(found) == len(rows) and 100 < len(out) < 300
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.97
    text = {r[0]: r[1] for r in rows}
    inserted = {"vilebad", "Nastyword,", "rotten"}
    named = [w for r in found if truth[r.doc_id] for x in r.spans for w in text[r.doc_id][x.start : x.end].split()]
    assert len(named) > 150 and sum(w in inserted for w in named) / len(named) > 0.95
    assert sum(len(r.spans) for r in found if not truth[r.doc_id]) < 0.05 * len(named)
    assert all(r.spans for r in found if r.predicted)
    model = toxicity.train(docs, given)
    for r in toxicity.spans(docs.where("doc_id < 60"), model).collect():
        assert rows[r.id][1][r.start : r.end] == r.span
    bad = spark.createDataFrame([(1, "w1  w2\n rotten vilebad, w3")], "doc_id long, text string")
    assert [(r.start, r.end) for r in toxicity.spans(bad, model).collect()] == [(8, 23)]


def test_compounds_are_known_by_their_beginning(spark):
    """Toxic words of one language that share a beginning, none of them frequent."""
    rng, rows, labels = random.Random(6), [], []
    for i in range(900):
        toxic = i % 5 == 0
        body = [f"{rng.choice('abcdefg')}{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(4 if toxic else 0):
            body.insert(rng.randrange(len(body)), f"schmier{rng.choice('xyz')}{rng.randrange(10**6)}")
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    found = toxicity.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    out = [r for r in found if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in out) / len(out) > 0.95


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.judge(odd, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].score == by_id[1].score == by_id[2].score and by_id[0].spans == by_id[1].spans == []  # null, empty and blank texts
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.judge(odd, none).collect()} == {0.0}
    assert toxicity.judge(empty, labels).count() == 0
