"""The corpus pipeline: quality, exact copies, near copies, source mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import exact_dedup, mixing, near_text, packing, quality, queries
from corpusgraph.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.accepted(docs, queries.trusted_ids(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.exact_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (0.8 of their five-word shingles and more), the document with the smallest doc_id stays."""
    return near_text.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until sources meet their targets."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a training sequence."""
    return packing.pack(docs, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.path(queries.RANKS))


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Perplexity, fingerprints and token ids are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
