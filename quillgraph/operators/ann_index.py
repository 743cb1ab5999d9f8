"""An approximate vector index on disk: cells, product-quantised residuals, an exact re-rank."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from math import ceil
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.vector import Nearest, blocks, matrix, recall, topk, unit
from quillgraph.runtime import if_small, materialize
from quillgraph.sources.manifest import Manifest

#: Bytes that all centres may take, as they are broadcast; sample rows a cell; rounds over them.
CENTRE_BYTES, PER_CELL, ROUNDS = 256 << 20, 64, 4
#: Rows that the codebooks are fitted on, codes of one part of a vector, dimensions that a part has at most.
CODE_ROWS, CODES, PART = 20_000, 256, 4
#: Query vectors that are broadcast at once.
QUERIES = 2048
#: Folders of the table at most; beyond, neighbouring cells share one.
SHELVES = 4096
#: Queries that probes and re-ranked rows are measured with, the share of true neighbours that they are to reach, and the most that are tried.
TRIAL, TARGET, MOST = 128, 0.95, 512


def _lloyd(rows: np.ndarray, k: int, rounds: int, spherical: bool) -> np.ndarray:
    """k centres of some rows in memory; fewer if there are fewer rows."""
    centres = rows[np.random.default_rng(0).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = _closest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, unit(sums) if spherical else sums / np.maximum(n, 1), centres)
    return centres


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (rows @ centres.T)).argmin(1)


@dataclass
class Model:
    """Centres of cells, each below one of a layer of hubs, and a codebook for each part of a residual."""

    centres: np.ndarray
    codebooks: list[np.ndarray]

    def __post_init__(self):
        hubs = max(1, round(len(self.centres) ** 0.5))
        self.hubs = _lloyd(self.centres, hubs, 3, True) if len(self.centres) > 1024 else np.zeros((1, self.centres.shape[1]))
        below = _closest(self.centres, self.hubs)
        order = np.argsort(below, kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(below, minlength=len(self.hubs)))[:-1])

    def cells(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The n cells nearest to each unit row, in order; of many cells, those below the nearest hubs."""
        n = min(n, len(self.centres))
        if len(self.hubs) == 1:
            score = rows @ self.centres.T
            return np.argsort(-score, axis=1, kind="stable")[:, :n] if n > 1 else score.argmax(1)[:, None]
        out = np.empty((len(rows), n), np.int64)
        far = np.argsort(-(rows @ self.hubs.T), axis=1, kind="stable")
        for k, row in enumerate(rows):
            found, seen = [], 0
            for place, hub in enumerate(far[k]):
                found.append(self.members[hub])
                seen += len(found[-1])
                if place >= 2 and seen >= 2 * n:
                    break
            near = np.concatenate(found)
            out[k] = near[np.argsort(-(self.centres[near] @ row), kind="stable")[:n]] if len(near) >= n else np.argsort(-(self.centres @ row), kind="stable")[:n]
        return out

    def codes(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The nearest code of each part of rows' residuals."""
        rest, at, out = rows - self.centres[cells], 0, []
        for book in self.codebooks:
            out.append(_closest(rest[:, at : at + book.shape[1]], book).astype(np.uint8))
            at += book.shape[1]
        return np.stack(out, axis=1)

    def products(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codes: (parts, queries, codes)."""
        at, out = 0, []
        for book in self.codebooks:
            own = np.zeros((len(queries), CODES), np.float32)
            own[:, : len(book)] = queries[:, at : at + book.shape[1]] @ book.T
            out.append(own)
            at += book.shape[1]
        return np.stack(out)


def _sample(corpus: DataFrame, rows: int, total: int) -> DataFrame:
    """About so many rows, chosen by a hash of their id."""
    return corpus.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, rows / max(1, total)) * (1 << 30)))


def _fit(corpus: DataFrame, width: int, total: int, cells: int | None) -> Model:
    """Centres by rounds over a sample that grows with their number, each one pass in tasks; codebooks from a bounded sample."""
    spark = corpus.sparkSession
    cells = min(cells or max(1, round(total**0.5)), CENTRE_BYTES // (8 * width))
    first = _sample(corpus, 2 * cells, total).orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(cells).select("embedding").toArrow()
    centres = unit(matrix(first.column("embedding").combine_chunks(), width)) if first.num_rows else np.zeros((1, width))
    some = materialize(_sample(corpus, PER_CELL * cells, total).select("embedding"), "sample")

    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(Model(centres, []))

        def sums(batches):
            model = shared.value
            total, n = np.zeros_like(model.centres), np.zeros(len(model.centres), np.int64)
            for batch in batches:
                rows = unit(matrix(batch.column("embedding"), width))
                near = model.cells(rows, 1)[:, 0] if len(rows) else np.zeros(0, np.int64)
                np.add.at(total, near, rows)
                n += np.bincount(near, minlength=len(n))
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array([x.tobytes() for x in total[hit]], pa.binary())], ["cell", "sums"])

        def added(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for cell, own in zip(batch.column("cell").to_pylist(), batch.column("sums").to_pylist()):
                    held[cell] = held.get(cell, 0) + np.frombuffer(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["cell", "sums"])

        schema = "cell long, sums binary"
        found = some.mapInArrow(sums, schema).repartition("cell").mapInArrow(added, schema).toArrow()  # a row a cell
        moved = centres.copy()
        for cell, own in zip(found.column("cell").to_pylist(), found.column("sums").to_pylist()):
            moved[cell] = unit(np.frombuffer(own)[None, :])[0]
        centres = moved
    rows = unit(matrix(_sample(corpus, CODE_ROWS, total).select("embedding").toArrow().column("embedding").combine_chunks(), width))
    model = Model(centres, [])
    rest = rows - centres[model.cells(rows, 1)[:, 0]] if len(rows) else np.zeros((1, width))
    return Model(centres, [_lloyd(np.ascontiguousarray(rest[:, at : at + PART]), CODES, 6, False) for at in range(0, width, PART)])


class Index:
    """An index in a folder: model, parts of rows, a catalogue of what each part's cells hold, and states that name them.

    Each `add` writes one more part and then a state, so readers see whole parts
    alone, an index outlives its session, and a job that dies leaves the state before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest = Manifest(spark, f"{self.folder}/states")
        self.number, self.state = self.manifest.latest()
        if self.number < 0:
            raise FileNotFoundError(f"no index in {folder}")
        self.width, self.probes, self.rerank = self.state["width"], self.state["probes"], self.state["rerank"]
        model = spark.read.parquet(f"{self.folder}/model").toArrow().to_pydict()  # CENTRE_BYTES and the codebooks
        parts = sorted(zip(model["part"], model["place"], model["vector"]))
        by = {p: np.array([np.frombuffer(v) for q, _, v in parts if q == p]) for p in sorted(set(model["part"]))}
        self.model = Model(by.pop(-1), list(by.values()))
        self._shelf = -(-len(self.model.centres) // SHELVES)
        self._shared = None

    @property
    def cells(self) -> int:
        return len(self.model.centres)

    @staticmethod
    def build(corpus: DataFrame, folder: str, width: int, cells: int | None = None, k: int = 10) -> Index:
        """Fit on samples of corpus(id, embedding), index every row, and measure how many cells and rows a search needs.

        There are as many cells as the root of the number of rows. Vectors are compared
        by their first ``width`` dimensions; null ones aren't indexed, one without length is like nothing.
        """
        spark, corpus = corpus.sparkSession, corpus.filter("embedding is not null and id is not null").select("id", "embedding")
        folder = folder.rstrip("/")
        model = _fit(corpus, width, corpus.count(), cells)
        rows = [(-1, n, bytearray(v.tobytes())) for n, v in enumerate(model.centres)] + [(p, n, bytearray(v.tobytes())) for p, book in enumerate(model.codebooks) for n, v in enumerate(np.ascontiguousarray(book))]
        spark.createDataFrame(rows, "part int, place int, vector binary").coalesce(1).write.parquet(f"{folder}/model")
        Manifest(spark, f"{folder}/states").commit(0, {"width": width, "probes": len(model.centres), "rerank": MOST, "parts": []})
        index = Index(spark, folder)
        index.add(corpus)
        index._measure(corpus, k)
        return index

    def _broadcast(self):
        if self._shared is None:
            self._shared = self.spark.sparkContext.broadcast(self.model)
        return self._shared

    def add(self, rows: DataFrame) -> None:
        """Index further rows(id, embedding) under the model as it is."""
        shared, width, shelf = self._broadcast(), self.width, self._shelf

        def coded(batches):
            model = shared.value
            for batch in batches:
                own = unit(matrix(batch.column("embedding"), width))
                cells = model.cells(own, 1)[:, 0] if len(own) else np.zeros(0, np.int64)
                codes = model.codes(own, cells) if len(own) else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").cast(pa.int64()), batch.column("embedding").cast(pa.list_(pa.float32())), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((cells // shelf).astype(np.int32))],
                    ["id", "embedding", "cell", "code", "shelf"],
                )

        rows = rows.filter("embedding is not null and id is not null").select("id", "embedding")
        name = f"part-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        found = rows.mapInArrow(coded, "id long, embedding array<float>, cell int, code binary, shelf int")
        found.repartitionByRange("shelf", "cell", "id").sortWithinPartitions("shelf", "cell", "id").write.partitionBy("shelf").parquet(path)  # a large cell spans several files
        self._counts(self._read(name)).coalesce(1).write.parquet(f"{self.folder}/catalogue/{name}")
        self._commit(self.state | {"parts": [*self.state["parts"], name]})

    def _commit(self, state: dict) -> None:
        self.manifest.commit(self.number + 1, state)
        self.number, self.state = self.number + 1, state

    def _read(self, part: str) -> DataFrame:
        schema = "id long, embedding array<float>, cell int, code binary, shelf int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}").withColumn("part", F.lit(part))

    def rows(self) -> DataFrame:
        """id, embedding, cell, code, shelf, part of all live parts."""
        found = None
        for part in self.state["parts"]:
            found = self._read(part) if found is None else found.unionByName(self._read(part))
        if found is None:
            return self.spark.createDataFrame([], "id long, embedding array<float>, cell int, code binary, shelf int, part string")
        return found

    @staticmethod
    def _counts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part", "cell").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("id", "code").cast("decimal(38,0)")).alias("checksum"))

    def check(self) -> DataFrame:
        """part, cell, problem: cells whose rows differ from the catalogue's: ``missing``, ``unknown``, ``rows`` or ``checksum``. No row: the index is whole."""
        schema = T.StructType.fromDDL("part string, cell int, rows long, checksum decimal(38,0)")
        listed = self.spark.createDataFrame([], schema)
        for part in self.state["parts"]:
            listed = listed.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/catalogue/{part}"))
        now = self._counts(self.rows()).select("part", "cell", F.col("rows").alias("n"), F.col("checksum").alias("sum"))
        both = listed.join(now, ["part", "cell"], "full")
        problem = F.when(F.col("n").isNull(), "missing").when(F.col("rows").isNull(), "unknown").when(F.col("n") != F.col("rows"), "rows").when(~F.col("sum").eqNullSafe(F.col("checksum")), "checksum")
        return both.select("part", "cell", problem.alias("problem")).filter("problem is not null")

    def _near(self, ids: np.ndarray, vectors: np.ndarray, probes: int, most: int, not_self: bool) -> DataFrame:
        """query_id, id, guess: the most rows with the highest estimates in each query's cells. Reads codes, not vectors."""
        nearest = self.model.cells(vectors, probes)
        asking = np.argsort(nearest.ravel(), kind="stable")
        first = np.searchsorted(nearest.ravel()[asking], np.arange(self.cells + 1))
        shared, asked = self._broadcast(), self.spark.sparkContext.broadcast((ids, vectors, (asking // nearest.shape[1]).astype(np.int32), first))

        def estimate(batches):
            qid, q, who, first = asked.value
            model = shared.value
            table, nearest = None, Nearest(len(qid), most)
            for batch in blocks(batches, len(qid)):
                if table is None:
                    table = model.products(q)
                cells, own = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for cell in np.unique(cells):
                    asks = who[first[cell] : first[cell + 1]]
                    if not len(asks):
                        continue
                    at = np.flatnonzero(cells == cell)
                    guess = np.repeat((q[asks] @ model.centres[cell]).astype(np.float32)[:, None], len(at), axis=1)
                    for part in range(codes.shape[1]):
                        guess += table[part][asks][:, codes[at, part]]
                    if not_self:
                        guess[qid[asks][:, None] == own[at][None, :]] = -np.inf
                    row, column = np.nonzero((guess > -np.inf) & (-guess <= nearest.worst[asks][:, None]))
                    nearest.offer(asks[row].astype(np.int64), -guess[row, column].astype(np.float64), own[at][column])
            query, key, found = nearest.rows()
            yield pa.RecordBatch.from_arrays([pa.array(qid[query].astype(np.int64)), pa.array(found), pa.array(-key)], ["query_id", "id", "guess"])

        rows = self.rows()
        shelves = sorted({int(c) // self._shelf for c in np.unique(nearest)})
        if len(shelves) < min(SHELVES, self.cells) and len(shelves) <= 1024:
            rows = rows.filter(F.col("shelf").isin(shelves))
        guesses = rows.select("id", "cell", "code").mapInArrow(estimate, "query_id long, id long, guess double")
        order = Window.partitionBy("query_id").orderBy(F.desc("guess"), "id")
        return guesses.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, most: int | None = None, not_self: bool = True) -> DataFrame:
        """query_id, rank, id, similarity as `vector.topk` gives them, of queries(id, embedding), from the index alone.

        Of the ``probes`` cells nearest to a query, the ``most`` rows with the highest
        estimates are compared exactly; both are by default what `build` measured.
        """
        width, found = self.width, None
        queries = queries.filter("embedding is not null and id is not null").select("id", "embedding")
        passes = -(-queries.count() // QUERIES)
        for n in range(passes):
            block = queries.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == n).orderBy("id").toArrow()
            if not block.num_rows:
                continue
            ids, vectors = block.column("id").to_numpy(), unit(matrix(block.column("embedding").combine_chunks(), width))
            near = materialize(self._near(ids, vectors, probes or self.probes, max(most or self.rerank, k), not_self).select("query_id", "id"), "near", light=True)
            asked = self.spark.sparkContext.broadcast((ids, vectors))

            def compare(batches):
                qid, q = asked.value
                for batch in batches:
                    which = np.searchsorted(qid, batch.column("query_id").to_numpy())
                    close = np.round((unit(matrix(batch.column("embedding"), width)) * q[which]).sum(1), 6)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(close)], ["query_id", "id", "similarity"])

            few = self.rows().select("id", "embedding").join(if_small(near, QUERIES * MOST), "id")
            part = few.select("query_id", "id", "embedding").mapInArrow(compare, "query_id long, id long, similarity double")
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.spark.createDataFrame([], "query_id long, id long, similarity double")
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")

    def _measure(self, corpus: DataFrame, k: int) -> None:
        """Set probes and re-ranked rows to the fewest with which some of the corpus's own rows find TARGET of their true neighbours."""
        asked = _sample(corpus, TRIAL, corpus.count()).limit(2 * TRIAL).select("id", "embedding")
        true = materialize(topk(corpus, asked, k, self.width).select("query_id", "id"), "true", light=True)
        block = asked.toArrow()
        total = true.count()
        if not total:
            return
        order = self.model.cells(unit(matrix(block.column("embedding").combine_chunks(), self.width)), self.cells)
        place = {q: {int(c): n for n, c in enumerate(row)} for q, row in zip(block.column("id").to_pylist(), order)}
        held = true.join(self.rows().select("id", "cell"), "id").collect()  # k rows a query
        ranks = sorted(place[r.query_id][r.cell] + 1 for r in held)
        probes = ranks[min(len(ranks), ceil(total * (1 + TARGET) / 2)) - 1]
        ids, vectors = block.column("id").to_numpy(), unit(matrix(block.column("embedding").combine_chunks(), self.width))
        by_id = np.argsort(ids)
        near = self._near(ids[by_id], vectors[by_id], probes, MOST, True).join(F.broadcast(true), ["query_id", "id"])
        places = sorted(r.place for r in near.select("place").collect())
        enough = ceil(total * TARGET)
        most = places[enough - 1] if len(places) >= enough else MOST
        self.probes, self.rerank = probes, max(int(most), 2 * k)
        self._commit(self.state | {"probes": self.probes, "rerank": self.rerank})


def report(index: Index, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: recall against the exact search, and the shares of codes and of vectors that a query reads on average."""
    asked = queries.filter("embedding is not null")
    got = recall(index.search(asked, k), topk(corpus, asked, k, index.width))
    sizes = {r.cell: r.n for r in index.rows().groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    total = max(1, sum(sizes.values()))
    width, probes, shared = index.width, index.probes, index._broadcast()

    def read(batches):
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(unit(matrix(batch.column("embedding"), width)), probes)
                yield pa.RecordBatch.from_arrays([pa.array([sum(sizes.get(int(c), 0) for c in row) / total for row in cells], pa.float64())], ["share"])

    share = asked.select("embedding").mapInArrow(read, "share double").agg(F.round(F.avg("share"), 6).alias("codes_read"))
    one = F.lit(1).alias("one")
    return got.select(one, "recall").join(share.select(one, "codes_read"), "one").drop("one").withColumns({"vectors_read": F.lit(round(min(index.rerank, total) / total, 6)), "cells": F.lit(index.cells), "probes": F.lit(probes)})


def sweep(indexes: dict[int, Index], corpus: DataFrame, queries: DataFrame, k: int, probes: tuple[int | None, ...] = (1, 4, 16, None), blocks: int = 4) -> DataFrame:
    """width, probes, recall, median_ms, p95_ms of the indexes by width, for each number of cells probed (None: the measured one).

    Queries are asked in blocks, as a search is a job; a block's time is divided
    by its queries, and the figures are over blocks.
    """
    spark, out = corpus.sparkSession, []
    asked = materialize(queries.filter("embedding is not null").select("id", "embedding"), "asked", light=True)
    parts = [asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n) for n in range(blocks)]
    sizes = [p.count() for p in parts]
    for width, index in sorted(indexes.items()):
        exact = materialize(topk(corpus, asked, k, width).select("query_id", "id"), "exact", light=True)
        for n in probes:
            times, found = [], None
            for part, size in zip(parts, sizes):
                if size:
                    began = time.perf_counter()
                    own = materialize(index.search(part, k, n), "found", light=True)
                    times.append(1000 * (time.perf_counter() - began) / size)
                    found = own if found is None else found.unionByName(own)
            if found is not None:
                times.sort()
                out.append((width, min(n or index.probes, index.cells), recall(found, exact).first().recall, round(median(times), 3), round(times[max(0, int(len(times) * 0.95) - 1)], 3)))
    return spark.createDataFrame(out, "width int, probes int, recall double, median_ms double, p95_ms double")
