"""Repeated lines: levelled sorted runs of line hashes, against which each new batch is merged.

DataFrame and SQL expressions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import documents
from quillgraph.runtime import materialize, shared_dir
from quillgraph.sources.manifest import Manifest

#: Code points that a line's key has at least, if it is to be compared.
LEAST = 10
#: Batches that one table is dealt into, and runs of one level that make one of the next.
BATCHES, FANOUT = 4, 2
#: Comes after all ids, for rows without one.
NO_ID = (1 << 63) - 1
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_KEY = "h long, g long, first long, last long, seen boolean"


class LineRuns:
    """Sorted runs of the keys of lines in a folder, each key in one run.

    A run is a table in buckets of a key's hash, sorted within each, so a batch
    that is dealt the same way meets it by a merge join without moving it. A new
    run is of level 0; as soon as a level holds ``fanout`` runs they become one of the next, so
    there are few, and a key is rewritten once a level. A state lists the live
    runs; it changes as a whole, after a run is written, so a job that dies
    leaves the state before, and a batch that is added again under its name
    gives what it gave.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.manifest = Manifest(spark, f"{self.folder}/states")
        self.number, state = self.manifest.latest()
        self.runs: list[dict] = state.get("runs", [])
        self.batches: dict[str, str] = state.get("batches", {})
        self.buckets: int = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: dict[str, str] = {}

    def _table(self, path: str) -> DataFrame:
        """A run's table, known to this session by a name, as buckets are a property of named tables."""
        if path not in self._tables:
            name = self._tables[path] = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({_KEY}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (h, g) SORTED BY (h, g) INTO {self.buckets} BUCKETS")
        return self.spark.table(self._tables[path])

    def _written(self, keys: DataFrame) -> str:
        path, name = f"{self.folder}/run-{uuid.uuid4().hex}", f"run_{uuid.uuid4().hex}"
        keys.write.format("parquet").option("path", path).bucketBy(self.buckets, "h", "g").sortBy("h", "g").saveAsTable(name)
        self._tables[path] = name
        return path

    def _commit(self, runs: list[dict], batches: dict[str, str]) -> None:
        self.number += 1
        self.manifest.commit(self.number, {"runs": runs, "batches": batches, "buckets": self.buckets})
        self.runs, self.batches = runs, batches

    def compact(self) -> None:
        """Make one run of the next level from each full level's runs."""
        level = 0
        while level <= max((r["level"] for r in self.runs), default=-1):
            full = [r for r in self.runs if r["level"] == level]
            if len(full) >= self.fanout:
                keys = None
                for r in full:
                    own = self._table(r["path"]).filter("not seen")
                    keys = own if keys is None else keys.unionByName(own)
                merged = self._written(keys.repartition(self.buckets, "h", "g"))
                self._commit([r for r in self.runs if r["level"] != level] + [{"level": level + 1, "path": merged}], self.batches)
            level += 1

    def add(self, lines: DataFrame, name: str) -> DataFrame:
        """h, g, first, last, seen of each key of lines(h, g, doc_id): its smallest and greatest doc_id here, and whether a run had it before.

        A null id is no key's smallest and the greatest of all. What no run had is this batch's own run.
        """
        if name not in self.batches:
            self.compact()
            keys = lines.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("last"))
            seen = F.lit(False)
            for k, r in enumerate(self.runs):
                run = self._table(r["path"]).filter("not seen").select("h", "g", F.lit(True).alias(f"in_{k}"))
                keys = keys.join(run.hint("merge"), ["h", "g"], "left")
                seen = seen | F.coalesce(F.col(f"in_{k}"), F.lit(False))
            path = self._written(keys.select("h", "g", "first", "last", seen.alias("seen")))
            self._commit([*self.runs, {"level": 0, "path": path}], self.batches | {name: path})
        return self._table(self.batches[name])

    def forget(self) -> None:
        """Take the tables' names out of this session; the files stay."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = {}


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits that tell rows apart: rows that share them have one id and one text, and lose the same lines."""
    rows = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("*", F.xxhash64("text").alias("r1"), F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "text").alias("r2"))


def _lines(texts: DataFrame, least: int, *more: Column) -> DataFrame:
    """One row a line whose key has at least so many code points: doc_id, r1, r2, pos, and 128 bits of hashes of the key."""
    split = texts.select("doc_id", "r1", "r2", *more, F.posexplode(F.split(F.translate("text", UPPER, UPPER.lower()), "\n")).alias("pos", "line"))
    keyed = split.withColumn("key", F.btrim(F.col("line"), F.lit(BLANKS))).filter(F.char_length("key") >= least)
    return keyed.withColumns({"h": F.xxhash64("key"), "g": F.xxhash64(F.lit(1), "key")}).drop("line", "key")


def dedup_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT, runs: LineRuns | None = None, name: str = "") -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every row of docs(doc_id, text): the text without lines that an earlier document has.

    Lines end at line feeds; a line's key is the line in lower case (A-Z) without
    blanks at its ends. Lines whose key has ``least`` code points and is found
    under two doc_ids are dropped except under the smallest, where all stay.
    Others stay, joined by line feeds; if none stays, the text is empty. A null
    text is an empty one, of one line. Null ids come after all others and count
    as one document; rows that share an id likewise, so their lines don't drop
    one another's. One row a row.

    Keys are hashed once, to 128 bits, and written; batches follow one another
    in the order of doc_id, dealt at its quantiles. Each batch's keys are summed
    in tasks first, so a line that a third of all documents have is a few rows a
    batch, and are then merged with the `runs` so far. With ``runs`` of the
    caller's, names of earlier calls have their keys there: lines that those
    texts had are dropped everywhere. Rows of lines meet the repeated keys in one
    join, which adaptive execution may split at a hot key, and texts meet their
    dropped places in another.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    bounds = texts.agg(F.percentile_approx("doc_id", [n / batches for n in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    part = sum(((F.col("doc_id") > b).cast("int") for b in sorted(set(bounds or []))), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(part).alias("batch")
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    _lines(texts, least, batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, r1 long, r2 long, pos int, h long, g long, batch int").parquet(path)

    own = runs or LineRuns(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}", fanout=fanout)
    repeated = None
    for n in range(batches):
        keys = own.add(lines.filter(F.col("batch") == n), f"{name}/{n}")
        found = keys.filter("seen or first < last").select("h", "g", F.lit(n).alias("batch"), F.when(~F.col("seen"), F.col("first")).alias("first"), "seen")
        repeated = found if repeated is None else repeated.unionByName(found)
    repeated = materialize(repeated, "repeated", light=True)
    if runs is None:
        own.forget()
    later = F.col("seen") | (F.col("doc_id").isNull() & F.col("first").isNotNull()) | (F.col("doc_id") > F.col("first"))
    dropped = lines.join(repeated, ["batch", "h", "g"]).filter(later).groupBy("r1", "r2").agg(F.collect_set("pos").alias("places"))  # places of one text's lines
    dropped = materialize(dropped, "dropped", light=True)
    joined = texts.join(dropped, ["r1", "r2"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda n: F.get("lines", n)), "\n"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))
