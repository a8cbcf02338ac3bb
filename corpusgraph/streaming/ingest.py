"""Incremental indexing: a stream of documents keeps an index and its vocabulary up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts as co
from ..sources import inventory as inv


def apply_batch(index: DataFrame, counts: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index (path, hash, lemmas), vocabulary (lemma, doc_count), a batch (path, text, and modified_ms if known) -> both after the batch.

    Of several texts of one path in a batch, the latest modified counts; where that is unknown or equal, as a batch has no order, the one of the largest hash.
    """
    when = F.coalesce("modified_ms", F.lit(0)) if "modified_ms" in batch.columns else F.lit(0)
    last = batch.groupBy("path").agg(F.max_by("text", F.struct(when, F.xxhash64("text"))).alias("text"))
    new = co.analyzed(last).select("path", F.array_distinct(F.col("tokens.lemma")).alias("lemmas"))
    new = new.join(last.select("path", inv.content_hash(F.col("text").cast("binary")).alias("hash")), "path")
    changed = new.join(index.select("path", F.col("hash").alias("old")), "path", "left").where("old IS NULL OR old <> hash").select("path", "hash", "lemmas")
    spread = lambda df: df.select("path", F.explode_outer("lemmas").alias("lemma")).where("lemma IS NOT NULL")
    gone = spread(index.join(changed.select("path"), "path", "left_semi"))
    return inv.upsert(index, changed), co.vocabulary_update(counts, gone, spread(changed))


def index_stream(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query over a stream of (path, text) that writes index and vocabulary versions under folder; each batch replaces its own version, so a repeated batch gives the same."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        if epoch:
            index, counts = spark.read.parquet(f"{folder}/index-{epoch - 1}"), spark.read.parquet(f"{folder}/vocabulary-{epoch - 1}")
        else:
            index, counts = spark.createDataFrame([], "path string, hash string, lemmas array<string>"), spark.createDataFrame([], "lemma string, doc_count long")
        index, counts = apply_batch(index, counts, batch)
        index.write.mode("overwrite").parquet(f"{folder}/index-{epoch}")
        counts.write.mode("overwrite").parquet(f"{folder}/vocabulary-{epoch}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
