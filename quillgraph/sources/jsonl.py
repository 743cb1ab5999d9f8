"""JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system that Spark reads it with."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are skipped, a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _written(df: DataFrame, path: str, mode: str) -> int:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).json(path)
    return seen.get["rows"]


def write(df: DataFrame, path: str) -> int:
    """Replace what is at path; returns the number of rows, counted while they are written."""
    return _written(df, path, "overwrite")


def append(df: DataFrame, path: str) -> int:
    """Add rows to a log; later rows supersede earlier ones when it is replayed."""
    return _written(df, path, "append")
