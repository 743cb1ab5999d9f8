"""A training-corpus pipeline over documents: quality, language, exact and near duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import exact_dedup, language_id, packing, quality, shingle_join
from quillgraph.runtime import if_small, materialize, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text that needs more bits a byte than this under every language's model resembles none of them.
MOST_BITS = 6.5


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a column ``row`` of 128 bits of hashes of id and text; rows that share it are equal texts of one id."""
    return docs.select(*COLUMNS, F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "text")).alias("row"))


def _kept(keyed: DataFrame, judge: Callable[[], DataFrame]) -> DataFrame:
    """The rows of keyed that judge()'s rows (row, kept) keep, one of those that share ``row``, which share the verdict too. What the judging wrote is deleted."""
    verdicts = settled(lambda: judge().select("row", "kept"), keyed.sparkSession, "verdicts")
    dropped = materialize(verdicts.filter("not kept").select("row").distinct(), "dropped", light=True)
    left = keyed.join(if_small(dropped), "row", "left_anti")
    if not verdicts.filter("kept").groupBy("row").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["row"])
    return left.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trusted-against-raw threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels, carry=COLUMNS).filter("kept").select("carried.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that some language's model explains; all with letters, if no language could be learned."""
    explained = F.col("bits_per_byte").isNull() | (F.col("bits_per_byte") <= MOST_BITS)
    return language_id.identify(docs, carry=COLUMNS).filter(explained & F.col("carried.text").rlike(r"\p{L}")).select("carried.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    keyed = _keyed(docs)
    return _kept(keyed, lambda: exact_dedup.exact_groups(keyed, key="row"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of Jaccard similarity 0.8 or more over shingles of five words join."""
    keyed = _keyed(docs)
    return _kept(keyed, lambda: shingle_join.near_duplicates(keyed, width=5, key="row"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every remaining document in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("packing", packing_stage),
]

#: SQL has no language models, fingerprints or tokenizers; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
