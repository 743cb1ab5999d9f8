"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, documents
from quillgraph.runtime import materialize


def exact_groups(docs: DataFrame, prefix: int = 64, key: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, and key if it is named.

    Texts are equal if they are so without white space. Of equals the row with
    the most code points stays, then the smallest doc_id (a null id after all
    others). A null text counts as empty. One row of a group is kept, also of
    rows that share doc_id and text. key: a column that tells rows apart (rows
    that share it share the verdict); without one, rows are numbered here.

    Groups by the length without white space, then by a hash of the first
    ``prefix`` characters, then, for groups of two rows or more alone, by the
    full hash. Only counts and winners are aggregated, which Spark does before
    the shuffle, so a third of all rows may be one text. The joins back to the
    rows are sort-merge joins that adaptive execution splits where one text has
    too many rows; the texts themselves are never shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id() if key is None else F.col(key)
    bare = documents(docs, row.alias("row")).select("doc_id", "row", F.char_length(text).alias("points"), F.regexp_replace(text, SPACE + "+", "").alias("bare"))
    rows = materialize(
        bare.select("doc_id", "row", "points", F.char_length("bare").alias("n"), F.xxhash64(F.substring("bare", 1, prefix)).alias("head"), F.sha2("bare", 256).alias("text_sha256")),
        "texts",
    )
    # length and prefix: what stands alone here has no equal
    # (both small tables are written, so that the joins read shuffles directly and Spark may split a hot key)
    coarse = materialize(rows.groupBy("n", "head").agg(F.count("*").alias("rows")).filter("rows > 1").select("n", "head"), "coarse", light=True)
    shared = rows.join(coarse, ["n", "head"], "left_semi")
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "row")
    # by the full hash alone: the join's partitions don't fit it, so each task sums first and the join may be split
    groups = shared.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min_by(F.struct("doc_id", "row"), order).alias("keep")).filter("group_size > 1")
    joined = rows.join(materialize(groups, "groups", light=True), "text_sha256", "left")
    alone = F.col("keep").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"),
        "text_sha256",
        *([F.col("row").alias(key)] if key else []),
    )
