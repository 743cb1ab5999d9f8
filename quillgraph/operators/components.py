"""Connected components: local contraction, then alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.runtime import materialize

#: Nodes that a task contracts at once; edges up to which a round is one job, as no node can have too many of them for a task.
HELD, SMALL = 200_000, 200_000


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v): edges from each node of a task's own components, as far as HELD nodes reach, to the smallest there."""

    def run(batches):
        parent: dict = {}

        def find(x):
            root = x
            while (up := parent[root]) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def out(schema):
            rows = [(x, r) for x in parent if (r := find(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], schema.field("u").type), pa.array([r for _, r in rows], schema.field("v").type)], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield out(batch.schema)
            schema = batch.schema
        if parent:
            yield out(schema)

    return edges.mapInArrow(run, edges.schema)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _to_least(pairs: DataFrame, wanted: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """(u, v: wanted(u, v), rows of pairs, with u's least neighbour m, or u itself if that is less, in place of u; u, m).

    Unless there are few edges, the least neighbours are written first: so the join
    reads its inputs from shuffles alone, and adaptive execution may broadcast the
    one or split the other where a node has very many links.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = low if small else materialize(low, "least", light=True)
    return wanted.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), low


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    pairs = _both(edges)
    return _to_least(pairs, pairs.filter("v > u"), small)[0].distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved, low = _to_least(down, down, small)
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """If each node has one edge, and that leads to one that has none itself."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is its smallest node.

    u and v share any ordered type. Nulls and loops are ignored. Each task first
    contracts its own edges (of numbers and strings), which leaves few and short
    chains. A round is two aggregations and their joins, written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    No node reaches the driver. Raises if rounds do not suffice.
    """
    now = edges.select("u", "v").filter("u <> v")
    if isinstance(now.schema["u"].dataType, (T.IntegralType, T.StringType)) and now.schema["u"].dataType == now.schema["v"].dataType:
        now = _contracted(now)
    else:
        now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(now.distinct(), "edges", light=True)
    for _ in range(rounds):
        if _settled(now):
            break
        small = now.count() <= SMALL
        now = _large_star(now, small)
        now = materialize(_small_star(now if small else materialize(now, "edges", light=True), small), "edges", light=True)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
