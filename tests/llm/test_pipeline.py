"""Each stage against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
from corpusgraph.llm import queries
from corpusgraph.llm.common import DOCUMENT_COLUMNS, materialize, table
from corpusgraph.llm.quality import classify

from .test_mixing import slow_targets
from .test_near_text import slow_components


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            pieces = out.toPandas()
            assert set(pieces.doc_id) == set(before.doc_id)
            assert pieces.groupby("sequence_id").length.sum().max() <= 1024
            assert len(pieces[pieces.piece == 0]) == len(before)
            break
        assert out.columns == DOCUMENT_COLUMNS
        after = out.toPandas()
        text = dict(zip(before.doc_id, before.text))
        assert all(text[i] == t for i, t in zip(after.doc_id, after.text))
        ids = Counter(after.doc_id)
        if name == "quality":
            kept = {r.doc_id for r in classify(docs, queries.trusted_ids(spark, sf_dir)).where("kept").collect()}
            assert set(ids) == kept and max(ids.values()) == 1
        elif name == "exact dedup":
            first = {}
            for i in sorted(text):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
            assert ids == Counter(first.values())
        elif name == "near dedup":
            assert ids == Counter(set(slow_components(text).values()))  # five-word shingles, Jaccard 0.8
        else:
            size = {i: len(t.encode().split()) for i, t in text.items()}
            totals, taken = Counter(), Counter()
            for i, s in zip(before.doc_id, before.source):
                totals[s] += size[i]
                taken[s] += size[i] * ids[i]
            want = slow_targets(totals)
            assert max(ids.values()) <= 3 and all(abs(taken[s] - want[s]) <= max(5, 0.05 * want[s]) for s in want)
        docs = spark.createDataFrame(after, docs.schema) if len(after) else docs
        before = after


def test_run_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls in any column, repeated rows and clashing names go through all stages; so does an empty table."""
    columns = DOCUMENT_COLUMNS
    labels = spark.createDataFrame([(9, 1, 0), (11, 1, 0), (None, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("empty", empty)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (name == "odd") and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    assert set(columns) <= set(odd.columns)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "piece", "sequence_id"} <= set(rows[0].asDict())


def test_a_written_stage_leaves_no_shuffle_files(spark):
    """What a stage shuffled for its table goes with the write; the session's own setting stays."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in str(blocks.getAllFiles().mkString("\n")).split("\n") if "/shuffle_" in f}
    before, was = shuffled(), spark.conf.get(setting)
    out = materialize(spark.range(5000).repartition(5, "id"), "some")
    left = shuffled() - before
    assert not left and out.count() == 5000 and spark.conf.get(setting) == was
