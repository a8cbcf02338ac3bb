import math
import random
from collections import Counter

import numpy as np

from corpusgraph.llm import quality

from .conftest import odd_rows


def slow_model(texts):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    c3 = Counter()
    for t in texts:
        line = ["<s>", "<s>", *t.split(), "</s>"]
        c3.update(zip(line, line[1:], line[2:]))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)

    def discounts(c):
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]

    d1, d2, d3 = discounts(c1), discounts(c2), discounts(c3)
    cut = lambda n, d: d[min(n, 3) - 1]

    def p1(w):
        total = sum(c1.values())
        mass = sum(cut(n, d1) for n in c1.values()) / total
        return (c1[w] - cut(c1[w], d1) if w in c1 else 0) / total + mass / (len(c1) + 1)

    def p2(v, w):
        own = {y: n for (x, y), n in c2.items() if x == v}
        if not own:
            return p1(w)
        total = sum(own.values())
        return (own[w] - cut(own[w], d2) if w in own else 0) / total + sum(cut(n, d2) for n in own.values()) / total * p1(w)

    def p3(u, v, w):
        own = {z: n for (x, y, z), n in c3.items() if (x, y) == (u, v)}
        if not own:
            return p2(v, w)
        total = sum(own.values())
        return (own[w] - cut(own[w], d3) if w in own else 0) / total + sum(cut(n, d3) for n in own.values()) / total * p2(v, w)

    def score(text):
        line = ["<s>", "<s>", *text.split(), "</s>"]
        return sum(math.log10(p3(*x)) for x in zip(line, line[1:], line[2:]))

    return score


def test_model_equals_definition(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d e f g the of".split()) for _ in range(rng.randrange(0, 25))) for _ in range(30)]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    score = slow_model(texts)
    probe = texts[:8] + ["", "zzz", "a zzz b", "the of the of a"]
    sizes, got = quality.log_probabilities(model, [t.encode() for t in probe])
    assert sizes.tolist() == [len(t.split()) for t in probe]
    assert np.allclose(got, [score(t) for t in probe], atol=1e-4)


def test_thresholds_by_language(spark):
    rng = random.Random(9)
    good = {"en": "the of and a cat dog sat on mat with big".split(), "de": "der die und ein hund katze lag auf matte mit".split()}
    rows = [(i, " ".join(rng.choice(good[lang]) for _ in range(60)), lang, "s", 0) for i in range(400) for lang in [("en", "de")[i % 2]]]
    rows += [(1000 + i, " ".join(f"zq{rng.random()}" for _ in range(60)), "en", "s", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    trusted = spark.range(300).withColumnRenamed("id", "doc_id")
    kept = {r.doc_id: r.kept for r in quality.classify(docs, trusted, train_docs=80).collect()}
    assert not any(kept[1000 + i] for i in range(30))
    assert sum(kept[i] for i in range(400)) >= 392


def test_repeated_words_fall_below(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), "en") for i in range(300)]
    rows[0] = (0, "on and " * 200, "en")  # trusted: the model knows the pair, but no text of it alone is low enough
    rows += [(1000 + i, "the same the same " * 200, "en") for i in range(20)]
    docs = spark.createDataFrame(rows[1:], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.classify(docs, spark.range(250).withColumnRenamed("id", "doc_id"), train_docs=100).collect()}
    assert sum(found[i].kept for i in range(1, 300)) >= 294  # those of the training sample score lower, and stay
    assert all(r.least_perplexity < r.threshold for r in found.values())
    assert not any(found[1000 + i].kept for i in range(20))


def test_every_language_trains_and_long_texts_count(spark):
    """More than 64 languages; a word that comes late in a long text is known."""
    rows = [(i, f"l{i % 90}a l{i % 90}b l{i % 90}c " * 20, f"x{i % 90}") for i in range(900)]
    rows.append((5000, "pad " * 9000 + "late " * 50, "x0"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.train(docs.where("doc_id = 5000").select("text"))
    assert quality.log_probabilities(model, [b"late"])[1][0] > quality.log_probabilities(model, [b"none"])[1][0]
    found = quality.classify(docs, docs.select("doc_id"), train_docs=5).collect()
    assert all(r.perplexity < 30 for r in found if r.doc_id < 5000)


def test_accepted_keeps_rows_and_columns(spark, odd, empty):
    trusted = spark.createDataFrame([(9,), (11,), (None,)], "doc_id long")
    kept = quality.accepted(odd, trusted)
    assert kept.columns == odd.columns
    want = [r for r, s in zip(odd_rows(), quality.classify(odd, trusted).collect()) if s.kept]
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(str(r) for r in want)
    assert quality.accepted(empty, trusted).count() == 0


def test_null_and_empty_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), *[(i, "a b c d", "en") for i in range(3, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.classify(docs, docs.select("doc_id"), train_docs=10).collect()}
    assert found[1].n_tokens == found[2].n_tokens == 0 and found[1].log10_prob == found[2].log10_prob < 0


def test_odd_rows(spark, odd, empty):
    trusted = spark.createDataFrame([(9,), (11,), (None,)], "doc_id long")
    assert len(quality.classify(odd, trusted).collect()) == len(odd_rows())
    none = spark.createDataFrame([], "doc_id long")
    assert all(r.kept for r in quality.classify(odd, none).collect())
    assert quality.classify(empty, none).count() == 0


def test_all_trusted_documents_train(spark, monkeypatch):
    """More trusted documents than any former bound, one word each: scores are those of the definition over all and over whole halves."""
    from corpusgraph.llm import ngram_shards

    rng = random.Random(6)
    texts = [" ".join(rng.choice("a b c d e f g the of".split()) for _ in range(rng.randrange(0, 12))) + f" n{i // 2}" for i in range(90)] + ["", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    trusted = docs.where("doc_id < 60").select("doc_id")
    folds = quality.halves(docs.where("doc_id < 60").select("doc_id", "lang"), "doc_id", "lang").withColumnRenamed("doc_id", "uid")
    half = {r.uid: r.fold for r in folds.collect()}
    models = [slow_model([texts[i] for i in range(60) if half[i] == f]) for f in (0, 1)]
    full = slow_model(texts[:60])
    want = [full(t or "") for t in texts]
    crossed = [models[1 - half[i]](texts[i]) for i in range(60)]
    for vocabulary, piece, shard in ((1 << 17, 1 << 19, 1 << 24), (5, 20, 100)):
        monkeypatch.setattr(ngram_shards, "VOCABULARY", vocabulary)
        monkeypatch.setattr(ngram_shards, "PIECE", piece)
        rows = docs.withColumnRenamed("doc_id", "uid").join(folds, "uid", "left")
        got = {r.uid: r for r in ngram_shards.perplexities(rows, shard).collect()}
        assert [got[i].n - 1 for i in range(len(texts))] == [len((t or "").split()) for t in texts]
        assert np.allclose([got[i].lp for i in range(len(texts))], want, atol=1e-4)
        assert np.allclose([got[i].crossed for i in range(60)], crossed, atol=1e-4)
    found = {r.doc_id: r.log10_prob for r in quality.classify(docs, trusted).collect()}
    assert np.allclose([found[i] for i in range(len(texts))], want, atol=1e-4)


def test_every_trusted_document_of_many_counts(spark):
    """1,500 trusted documents, above the 600 of the former sample: each one's own word is known to its copy."""
    rows = [(i, f"a b c own{i} d e", "en") for i in range(1500)] + [(10_000 + i, f"a b c own{i} d e", "en") for i in range(1500)] + [(20_000, "a b c other d e", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.log10_prob for r in quality.classify(docs, docs.where("doc_id < 1500").select("doc_id")).collect()}
    assert all(found[10_000 + i] > found[20_000] for i in range(1500))


def test_tables_hold_a_row_per_document_and_shuffles_go(spark, monkeypatch):
    """Words outside the vocabulary make no rows of their own, and what was shuffled for a written table is gone."""
    from corpusgraph.llm import ngram_shards

    tables, kept = {}, ngram_shards.materialize
    shuffled = lambda: sum("shuffle_" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    def noted(df, name):
        before = shuffled()
        out = kept(df, name)
        tables.setdefault(name, []).append((out.count() if name == "shard-sums" else 0, shuffled() - before))
        return out

    monkeypatch.setattr(ngram_shards, "VOCABULARY", 3)
    monkeypatch.setattr(ngram_shards, "materialize", noted)
    docs = spark.createDataFrame([(i, i % 3, f"a b w{i} x{i // 2} y{i % 7} " * 3) for i in range(60)], "uid long, fold int, text string")
    assert ngram_shards.perplexities(docs, 1000).count() == 60
    assert max(n for n, _ in tables["shard-sums"]) <= 60
    assert all(left <= 0 for name in ("shard-counts", "predecessors") for _, left in tables[name])
