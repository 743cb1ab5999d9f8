"""Session helpers: sessions, shared folders, materialised intermediates."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch. Documents can be long, so batches stay short.
ARROW_ROWS, ARROW_BYTES = 512, 2 << 20


def session(cpus: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that the engine is tested with."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quillgraph")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its task's buffers hold at once: few rows a batch, as rows are whole documents, and few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (local tests) a folder of this machine is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a context.

    Nothing is done where they have it: on PYTHONPATH, or sent by ``--py-files``.
    The archive lies in the shared folder, so executors that start later get it too.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(here)
    context = spark.sparkContext
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if not os.path.isdir(here) or root in on_path or f"{name}.zip" in context._python_includes:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(here):
            for file in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, file)
                archive.write(full, os.path.relpath(full, root))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/{name}.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path.toString())


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "step", light: bool = False) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again.

    Cuts the lineage in a way that outlives lost executors, and gives later
    joins true sizes. light: rows cost little to make, so adaptive execution
    merges small partitions up to its advised size, instead of keeping every
    core busy with a small file each.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false") if light else nullcontext():
        df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that `settled` will delete, one list for each of its calls that runs.
_SCRATCH: list[list[str]] = []


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str = "settled") -> DataFrame:
    """make()'s rows, written like those of `materialize`; all tables that it wrote on the way are deleted then.

    For results that are small against what they are made of. make's result
    must be all that goes on to be used: a table that it read while it was made is gone.
    """
    _SCRATCH.append([])
    try:
        result = materialize(make(), name, light=True)
    finally:
        made = _SCRATCH.pop()
    if _SCRATCH:
        _SCRATCH[-1].append(made[-1])
    _delete(spark, made[:-1])
    # Spark deletes the shuffle files of finished steps when the driver collects what named them, which by itself may be half an hour later
    spark.sparkContext._jvm.System.gc()
    return result


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `materialize` wrote and that nothing will read again."""
    _delete(table.sparkSession, sorted({file.rsplit("/", 1)[0] for file in table.inputFiles()}))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        files(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(files(path), True)


#: Rows of a narrow table that may be broadcast: some bytes each.
BROADCAST_ROWS = 500_000


def if_small(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most so many rows; beyond, joins with it shuffle."""
    return F.broadcast(narrow) if narrow.count() <= rows else narrow


def numbered(df: DataFrame, order: list[str], name: str = "place", weight: str | None = None) -> DataFrame:
    """df with each row's number from 0 in the given order, or the sum of a whole-number weight before it, without gathering all rows in one task.

    Rows are dealt by ranges of the order and numbered within each; what lies
    before a range is the sum of the smaller ranges' counts, one number a range.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id())
    kept = materialize(dealt, "ranges")
    counts = sorted((r["_range"], r["n"]) for r in kept.groupBy("_range").agg((F.sum(weight) if weight else F.count("*")).alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before += [F.lit(part), F.lit(total)]
        total += n
    ranked = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    own = F.coalesce(F.sum(weight).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(ranked) - 1
    start = F.create_map(*before)[F.col("_range")] if before else F.lit(0)
    return kept.withColumn(name, (own + start).cast("long")).drop("_range")
