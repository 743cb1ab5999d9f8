"""What the operators of this folder share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import short_batches

#: White space of the contracts, as a class of Java's and of RE2's expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def bucket(column: str, of: int) -> Column:
    """crc32 of an id's text, modulo ``of``. A null id is in bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of, F.lit(0))


def documents(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text of docs, then the further columns; whatever else docs has stays behind."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def raw(column: pa.Array) -> list:
    """A string column's values as UTF-8 bytes (None: null)."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
