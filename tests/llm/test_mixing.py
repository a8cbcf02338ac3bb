import itertools
import random

from corpusgraph.llm import mixing

from .conftest import odd_rows


def slow_targets(totals, weights=(5, 2, 1), limit=3):
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(totals.values())), set(order)
    while True:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > limit * totals[s]}
        if not over:
            break
        for s in over:
            target[s] = float(limit * totals[s])
        free -= over
        left = sum(totals.values()) - sum(target.values())
    return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}


def test_bounded_sums_are_nearest():
    rng = random.Random(1)
    for _ in range(60):
        counts = [(length, rng.randrange(1, 4)) for length in sorted(rng.sample(range(1, 30), 4), reverse=True)]
        budget = rng.randrange(0, 120)
        got = mixing._bounded_sums(budget, counts)
        assert all(got.get(length, 0) <= have for length, have in counts)
        sums = [sum(k * length for k, (length, _) in zip(ks, counts)) for ks in itertools.product(*(range(h + 1) for _, h in counts))]
        assert abs(budget - sum(k * v for k, v in got.items())) == min(abs(budget - s) for s in sums)


def check(rows, found):
    size = lambda t: len((t or "").encode().split())
    totals = {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + size(r[1])
    want = slow_targets(totals)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r.source_size == totals[r.src] and abs(r.target - want[r.src]) < 1e-6 * max(1, want[r.src])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.src] = taken.get(r.src, 0) + r.taken
    return {s: taken[s] - want[s] for s in want}


def test_odd_rows(odd, empty):
    found = mixing.mix(odd).collect()
    check(odd_rows(), found)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(odd.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0


def test_targets_are_met(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 300), "en", f"s{i % 7}" if i % 3 else "s0", 0) for i in range(2000)]
    rows += [(5000 + i, "same words here", "en", "s0", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    off = check(rows, mixing.mix(df).collect())
    assert all(abs(x) <= 1 for x in off.values()), off


def test_knapsack_of_very_long_texts_keeps_little():
    import tracemalloc

    counts = [(length, 1) for length in range(2_000_000, 1_999_400, -2)]  # one parity, so that an odd budget is never hit
    tracemalloc.start()
    got = mixing._bounded_sums(2_999_999, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lengths = [length for length, _ in counts]
    near = min(abs(2_999_999 - s) for s in [*lengths, *(lengths[-1] + length for length in lengths[:-1])])
    assert peak < 60_000_000 and abs(2_999_999 - sum(k * v for k, v in got.items())) == near


def test_mix_keeps_columns(spark, odd, empty):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(empty).count() == 0
    copies = {}
    for r in out.collect():
        copies[str(r)] = copies.get(str(r), 0) + 1
    rows = {str(r) for r in odd.collect()}
    assert set(copies) <= rows
    assert sum(r.copies for r in mixing.mix(odd).collect()) == sum(copies.values())
    deep = spark.createDataFrame([(i, "a b c", "s", ({"k": i},), [{"k": i}]) for i in range(9)], "doc_id long, text string, source string, deep struct<m: map<string, long>>, many array<map<string, long>>")
    assert mixing.mixed(deep).count() == 9


def test_one_very_long_text(spark):
    rows = [(i, "w " * (2_000_000 if i == 0 else 50 + i), "en", f"s{i % 2}", 0) for i in range(40)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    check(rows, found)
