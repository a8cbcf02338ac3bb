import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import max_score

SCHEMA = "vec_id long, embedding array<float>, label int, shard long, vector string"


def rows():
    rng = np.random.default_rng(3)
    out = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], 1, 2, "x") for i in range(400)]
    sparse = rng.normal(0, 0.3, (200, 8)) * (rng.random((200, 8)) < 0.2)
    out += [(400 + i, [float(np.float32(x)) for x in v], None, None, None) for i, v in enumerate(sparse)]
    out += [(700 + i, out[3][1], 1, 1, "copy") for i in range(60)]
    out += [(800, None, 1, 1, ""), (801, [0.5, None], 1, 1, ""), (802, [math.nan] * 8, 1, 1, ""), (803, [math.inf] * 8, 1, 1, ""), (None, out[7][1], 1, 1, "")]
    return [*out, (850, [], 1, 1, ""), (851, [9.0, 1.0], 1, 1, ""), out[5], out[50], (900, [-1.0] * 8, 1, 1, "")]


def brute(given, k, scale=256):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in given if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in whole:
        if q is None or q % 50 or q in out and out[q][0] <= v:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for i, w in whole if i != q]
        out[q] = (v, [(rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])])
    return {(q, *r) for q, (_, top) in out.items() for r in top}


@pytest.mark.parametrize("k, shard, block, parts", [(5, 65_536, 16_384, 3), (1, 40, 3, 1), (1000, 100, 5, 2)])
def test_equals_brute_force(spark, k, shard, block, parts):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(parts)
    found = max_score.search(df, df.where("vec_id % 50 = 0"), k, shard_rows=shard, block_queries=block).collect()
    assert {tuple(r) for r in found} == brute(rows(), k) and len(found) == len(brute(rows(), k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=5, max_size=5), min_size=1, max_size=30), st.lists(st.integers(-4, 4), min_size=5, max_size=5), st.integers(-20, 60))
def test_no_row_of_the_least_score_is_lost(vectors, query, least):
    block, query = np.array(vectors), np.array(query)
    at, scores = max_score.Postings(block).search(query, least)
    assert (block[at] @ query == scores).all()
    assert set(np.flatnonzero(block @ query >= least)) <= set(at.tolist())


def test_large_components_are_exact(spark):
    df = spark.createDataFrame([(0, [3e9, 7e9]), (1, [4e9, 5e9]), (2, [4e9, 5.1e9]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    found = max_score.search(df, df.where("vec_id = 0"), 3).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and min(r.score for r in found) > 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert max_score.search(df, df, 5).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, 1, "")], SCHEMA)
    assert max_score.search(one, one, 5).count() == 0
