"""Vector search: exact by blocks of queries, approximate by inverted cells with an exact re-rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast at once; more take further passes over the corpus.
QUERIES = 8192
#: Similarities that a task holds at once, and rows that wait to be ranked.
HELD = 1 << 20
CELLS, PROBES, SAMPLE = 64, 40, 20_000


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The first dimensions of a list column's vectors, a row each; what a null or short one lacks is 0."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and sizes.min() == sizes.max() >= width:
        return values.reshape(len(sizes), -1)[:, :width]
    held = np.arange(width) < sizes[:, None]
    rows = np.zeros((len(sizes), width))
    rows[held] = values[((np.cumsum(sizes) - sizes)[:, None] + np.arange(width))[held]]
    return rows


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def blocks(batches, queries: int):
    """The batches, cut so that all queries' similarities to a block's rows are HELD at most."""
    rows = max(1, HELD // max(1, queries))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Nearest:
    """Of the rows offered to each query the k with the least keys; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.worst = k, np.full(queries, np.inf)
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.waiting, self.n = [], 0

    def offer(self, query: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((query, key, ids))
        self.n += len(query)
        if self.n > max(HELD, len(self.best[0])):
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query's place, key, id of what is kept so far."""
        query, key, ids = (np.concatenate(x) for x in zip(self.best, *self.waiting))
        self.waiting, self.n = [], 0
        order = np.lexsort((ids, key, query))
        query, key, ids = query[order], key[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept, full = place < self.k, place == self.k - 1
        self.worst[query[full]] = key[full]
        self.best = query[kept], key[kept], ids[kept]
        return self.best


def _top(spark, corpus: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, width: int, not_self: bool, cells: Cells | None = None, probes: int = 0) -> DataFrame:
    """k rows of the corpus a query and task; with cells, only those in the probes cells nearest to a query are compared."""
    near = cells.nearest(vectors, probes) if cells else None
    who = [np.flatnonzero((near == c).any(1)) for c in range(len(cells.centres))] if cells else None
    shared = spark.sparkContext.broadcast((ids, vectors, cells, who))

    def run(batches):
        qid, q, cells, who = shared.value
        nearest = Nearest(len(qid), k)
        for batch in blocks(batches, len(qid)):
            own, rows = batch.column("id").to_numpy(), unit(matrix(batch.column("embedding"), width))
            at = cells.nearest(rows, 1)[:, 0] if cells else np.zeros(len(rows), np.int64)
            for cell in np.unique(at):
                asks, here = who[cell] if cells else np.arange(len(qid)), np.flatnonzero(at == cell)
                far = q[asks] @ rows[here].T
                np.negative(np.round(far, 6, out=far), out=far)
                if not_self:
                    far[qid[asks][:, None] == own[here][None, :]] = 3
                row, column = np.nonzero((far <= nearest.worst[asks][:, None]) & (far < 3))
                nearest.offer(asks[row], far[row, column], own[here][column])
        query, key, found = nearest.rows()
        yield pa.RecordBatch.from_arrays([pa.array(qid[query].astype(np.int64)), pa.array(found), pa.array(-key)], ["query_id", "id", "similarity"])

    return corpus.select("id", "embedding").mapInArrow(run, "query_id long, id long, similarity double")


def topk(corpus: DataFrame, queries: DataFrame, k: int, width: int, not_self: bool = True) -> DataFrame:
    """query_id, rank, id, similarity: the k nearest rows of corpus(id, embedding) by cosine for each of queries(id, embedding).

    Exact. Similarities are rounded to six digits; ties go to the smaller id.
    Queries are taken in blocks of QUERIES, a bounded broadcast; a pass over the
    corpus keeps k rows a query in each task, so what is shuffled is k rows a
    query and task. Null embeddings aren't searched.
    """
    return _searched(corpus, queries, k, width, not_self)


def _searched(corpus: DataFrame, queries: DataFrame, k: int, width: int, not_self: bool, *probed) -> DataFrame:
    spark = corpus.sparkSession
    corpus, queries = corpus.filter("embedding is not null"), queries.filter("embedding is not null")
    passes = -(-queries.count() // QUERIES)
    found = None
    for n in range(passes):
        block = queries.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == n).select("id", "embedding").orderBy("id").toArrow()
        ids, vectors = block.column("id").to_numpy(), unit(matrix(block.column("embedding").combine_chunks(), width))
        part = _top(spark, corpus, ids, vectors, k, width, not_self, *probed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


class Cells:
    """Centres of an inverted index over unit vectors, fitted on a bounded sample by spherical k-means."""

    def __init__(self, sample: np.ndarray, cells: int = CELLS, rounds: int = 12):
        rng = np.random.default_rng(0)
        rows = unit(sample)
        self.centres = rows[rng.permutation(len(rows))[: min(cells, len(rows))]]
        for _ in range(rounds):
            near = (rows @ self.centres.T).argmax(1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, rows)
            self.centres = np.where(np.abs(sums).sum(1, keepdims=True) > 0, unit(sums), self.centres)

    def nearest(self, rows: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(unit(rows) @ self.centres.T), axis=1, kind="stable")[:, :n]


def fit_cells(corpus: DataFrame, width: int, cells: int = CELLS) -> Cells:
    """Centres from about SAMPLE rows, chosen by a hash of their id; every row is indexed later."""
    rate = min(1.0, SAMPLE / max(1, corpus.count()))
    rows = corpus.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20))).select("embedding").toArrow()
    return Cells(matrix(rows.column("embedding").combine_chunks(), width), cells)


def ann(corpus: DataFrame, queries: DataFrame, k: int, width: int, probes: int = PROBES, cells: Cells | None = None) -> DataFrame:
    """query_id, rank, id, similarity as topk gives them, from the rows in the ``probes`` cells nearest to each query.

    Queries are taken in blocks as there; a row meets those that probe its cell, and is compared exactly.
    """
    return _searched(corpus, queries, k, width, True, cells or fit_cells(corpus, width), probes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact(query_id, id) that found has."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.round(F.coalesce(F.try_divide(F.count("hit"), F.count("*")), F.lit(0.0)), 6).alias("recall"))
