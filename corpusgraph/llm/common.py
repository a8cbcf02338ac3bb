"""Helpers that the operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, shared_dir

__all__ = ["DOCUMENT_COLUMNS", "as_bytes", "crc_mod", "discard", "materialize", "release", "shared_dir", "table", "text_of", "with_row_id"]

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_id(docs: DataFrame, name: str = "uid") -> DataFrame:
    """docs with a number for each row, unlike in all rows; fixed only once the result is materialized."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(id_column, modulus: int):
    """crc32 of the id's decimal text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def release() -> None:
    """Give freed memory back to the system: a worker is kept for other stages after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
