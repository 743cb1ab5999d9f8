"""Near duplicates by SimHash fingerprints and BK-trees."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import documents, raw
from quillgraph.operators.components import connected_components
from quillgraph.runtime import materialize

#: A shard with more fingerprints is cut into tiles of this many, joined two by two.
TILE = 2048
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(_hash, shingles), np.uint64)


def print_of(hashes: np.ndarray) -> int:
    """64 bits: each is 1 if set in over half of the hashes. 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 5) -> int:
    """The SimHash of a text's word shingles."""
    return print_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and fp, a signed 64-bit number, for each row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t or b"", width) for t in raw(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int) -> list[int]:
        """Numbers of the values within the radius: only edges that differ from the distance by at most it can lead to one."""
        if not self.values:
            return []
        found, todo, radius, values, children = [], [0], self.radius, self.values, self.children
        while todo:
            n = todo.pop()
            d = (values[n] ^ value).bit_count()
            if d <= radius:
                found.append(n)
            below = children[n]
            if len(below) <= 2 * radius + 1:
                todo += [to for edge, to in below.items() if -radius <= edge - d <= radius]
            else:
                todo += [below[edge] for edge in range(d - radius, d + radius + 1) if edge in below]
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        n = 0
        while new:
            d = (self.values[n] ^ value).bit_count()
            if d not in self.children[n]:
                self.children[n][d] = new
                break
            n = self.children[n][d]
        return new


def _links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join each of a shard's unsigned fingerprints to the smallest of its class there: one a value at most."""
    tree, root = BkTree(radius), list(range(len(fps)))

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for n, value in enumerate(fps):
        for m in tree.near(value):
            a, b = find(m), find(n)
            if a != b:
                if fps[a] > fps[b]:
                    a, b = b, a
                root[b] = a
        tree.add(value)
    return [(value, fps[r]) for n, value in enumerate(fps) if (r := find(n)) != n]


def _masks(radius: int, agree: int) -> list[int]:
    """Masks of ``agree`` of radius + agree blocks of the 64 bits: two values within the radius are equal under one at least."""
    blocks = radius + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), agree)]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """u, v: links between the values of distinct(fp) that join all values within the radius.

    Every two values within the radius differ in at most ``radius`` of radius + 2
    blocks of bits, so they share a shard: the values that agree in two blocks. A
    shard is a BK-tree; it gives one link a value, to the smallest value of its
    class, not all pairs. A shard of more than TILE values (many near copies) is
    cut by a hash into tiles, and each two tiles get a tree, so no task holds it
    whole and no pair is lost.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(radius, 2)]
    shards = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "bits"))
    large = shards.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("mask", "bits", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    dealt = shards.join(large, ["mask", "bits"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.select("mask", "bits", "fp", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), "own")
    dealt = dealt.select("mask", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")

    def rows(pairs):
        found = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    def run(batches):
        key, fps = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "bits", "a", "b")]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = np.concatenate(([0], np.flatnonzero(change), [batch.num_rows]))
            fp = batch.column("fp").to_numpy().view(np.uint64)
            out = []
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
                this = tuple(c[low] for c in columns)
                if this != key:
                    out += _links(fps, radius) if len(fps) > 1 else []
                    key, fps = this, []
                fps += fp[low:high].tolist()
            if out:
                yield rows(out)
        if len(fps) > 1 and (out := _links(fps, radius)):
            yield rows(out)

    keys = ["mask", "bits", "a", "b"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row of docs(doc_id, text).

    Fingerprints link if at most ``radius`` bits differ; component_id is the
    smallest doc_id that links reach, null if all ids there are null. A null or
    empty text has fingerprint 0 and links like any other. Each row gives one
    row: rows of one doc_id and unlike texts are in their own texts' components.
    The graph's nodes are the distinct fingerprints, with or without ids, so a
    group of copies costs one row after partial aggregation.
    """
    rows = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", light=True)
    found = connected_components(links(distinct.select("fp"), radius))
    nodes = materialize(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "nodes", light=True)
    names = materialize(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "names", light=True)
    labels = materialize(nodes.join(names, "component").select("fp", "component_id"), "labels", light=True)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(labels, "fp").select("doc_id", hexed, "component_id")
