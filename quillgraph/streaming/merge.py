"""Incremental upserts of the stores, batch by batch, into tables of which only what a batch touches is rewritten."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.runtime import materialize
from quillgraph.sources.manifest import Manifest


class Bucketed:
    """A Parquet table in buckets of a hash of its key.

    A state says which folder holds each bucket. A merge reads and rewrites the
    buckets that its batch has keys of, into new folders, and then
    commits the state that names them: readers see whole versions, and a job
    that dies leaves the one before. Folders that the last states don't name are
    swept. A batch's number is part of the state, so a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.manifest = Manifest(spark, f"{self.path}/states")
        self.buckets = self.manifest.latest()[1].get("buckets", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(state.get("folders", {}).items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The table as it is, or as a state's number had it."""
        return self._rows(self.manifest.latest()[1] if number is None else self.manifest.read(number))

    def merge(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], number: int) -> bool:
        """Put merge(old, batch) in place of the buckets that batch touches; False if this or a later batch is in already.

        merge may only give rows whose keys are in one of its two tables.
        """
        version, state = self.manifest.latest()
        if number <= state.get("batch", -1):
            return False
        batch = materialize(batch, "batch", light=True)
        touched = {r.bucket for r in batch.select(self._bucket().alias("bucket")).distinct().collect()}  # the number of buckets at most
        folders = dict(state.get("folders", {}))
        if touched:
            folder = f"data-{uuid.uuid4().hex}"
            new = merge(self._rows(state, touched), batch).select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", self._bucket())
            new.repartitionByRange(F.col("bucket"), *self.keys).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")  # a large bucket is several tasks' work
            written = self._listed(folder)
            folders = {b: f for b, f in folders.items() if int(b) not in touched} | {str(b): folder for b in touched if b in written}
        self.manifest.commit(version + 1, {"folders": folders, "batch": number, "buckets": self.buckets})
        return True

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _listed(self, folder: str) -> set[int]:
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}"))]
        return {int(n[7:]) for n in names if n.startswith("bucket=")}

    def sweep(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` states names; returns how many."""
        numbers = self.manifest.numbers()
        live = {f for n in numbers[-keep:] for f in self.manifest.read(n).get("folders", {}).values()}
        fs, path = self._fs()
        old = [s.getPath() for s in fs.listStatus(path(self.path)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in live]
        for folder in old:
            fs.delete(folder, True)
        return len(old)


def upsert_stream(stream: DataFrame, table: Bucketed, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into the table; what is there at the start is processed, then the query ends."""

    def one(batch: DataFrame, number: int) -> None:
        table.merge(batch, merge, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
