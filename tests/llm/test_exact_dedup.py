import hashlib
import re

import pytest

from corpusgraph.llm.exact_dedup import exact_distinct, exact_duplicates, normalize

from .conftest import odd_rows


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    out = []
    for norm, ids in groups.items():
        known = [x for x in ids if x is not None]
        keep = min(known) if known else None
        out += [(x, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for x in ids]
    return sorted(out, key=str)


def test_normalize():
    for t in ("", " ", "a", " \n a\tb  ", "a\x0b\x0cb", "a\x1cb", "a\xa0b"):
        assert normalize(t.encode()) == re.sub(rb"[\x20\x09-\x0D]+", b" ", t.encode())


@pytest.mark.parametrize("parts", [1, 7])
def test_groups(spark, odd, parts):
    found = exact_duplicates(odd.repartition(parts)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute([r[:2] for r in odd_rows()])
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)


def test_a_hot_group_spans_partitions(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = exact_duplicates(df.repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)
    assert sum(r.kept for r in found) == 1001


def test_distinct_keeps_columns(odd, empty):
    found = exact_distinct(odd)
    assert found.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in found.collect()) == sorted(r.doc_id or -1 for r in exact_duplicates(odd).where("kept").collect())
    assert exact_distinct(empty).count() == 0 and exact_duplicates(empty).count() == 0


def test_ids_of_other_types(spark):
    rows = [("b", "x  y"), ("a", "x y"), (None, "x y"), ("c", "z"), ("d", None), ("e", "")]
    kept = exact_distinct(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in kept) == ["a", "c", "d"]
