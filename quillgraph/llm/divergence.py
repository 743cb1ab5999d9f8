"""How far the sources of a language lie apart: exact integer divergences of their smoothed term shares."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import raw
from quillgraph.runtime import materialize, short_batches

#: Documents of a language that a term is kept for, parts that shares are counted in, and terms that are listed for each group.
LEAST, SCALE, LISTED = 3, 1_000_000_000, 200
#: Terms in a chunk of the vocabulary and chunks in a slab, on average; groups in a block.
CHUNK, SLAB, BLOCK = 4096, 8, 32
#: Distinct terms that a task counts before it hands them on, and bytes of a text that are split at once.
HELD, PIECE = 400_000, 1 << 20

#: Bytes of terms: letters of ASCII in lower case, and all of other characters. The rest are spaces.
_TERM = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def _terms(text: bytes):
    """Lists of a text's terms, a piece at a time."""
    start = 0
    plain = text.translate(_TERM)
    while start < len(plain):
        stop = plain.find(b" ", start + PIECE)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


def _count(batches):
    """lang, source, term, n, docs of a task's rows: occurrences and documents; a null term counts the group's documents."""
    groups: dict[tuple[str, str], list] = {}
    held = 0

    def flush():
        for (lang, source), (n, docs, rows) in groups.items():
            terms = list(n)
            sizes = [rows, *map(docs.__getitem__, terms)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(sizes), pa.string()),
                    pa.array([source] * len(sizes), pa.string()),
                    pa.array([None, *terms], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw(batch.column("text"))):
            n, docs, rows = found = groups.setdefault((lang, source), [Counter(), Counter(), 0])
            found[2] = rows + 1
            before, own = len(n), set()
            for part in _terms(text):
                n.update(part)
                own.update(part)
            docs.update(own)
            held += len(n) - before
        if held > HELD:
            yield from flush()
            held = 0
    yield from flush()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", whole, total.cast("decimal(20,0)")) + 1


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays: SCALE is multiplied in three steps, so that nothing overflows below 9 * 10**15 terms."""
    share, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        share = share * 1000 + more
    return share + 1


def _tiles(batches):
    """lang, source, item, value of each pair of groups of a tile, summed over the chunks of a slab that follow one another."""
    tile, sums, names = None, None, []
    chunk, rows = None, []

    def add():
        """Add the chunk's terms to the tile's submatrix."""
        nonlocal rows, sums, names
        rows.sort(key=lambda r: (r[0], r[1]))
        names = [(r[0], r[1]) for r in rows]
        size = rows[0][2]
        counts = np.zeros((len(rows), size), np.int64)
        for k, r in enumerate(rows):
            counts[k, r[4]] = r[5]
        p = _shares(counts, np.array([r[3] for r in rows], np.int64)[:, None])
        block = np.array([r[0] for r in rows])
        if sums is None:
            sums = np.zeros((len(rows), len(rows)), np.int64)
        for k in range(len(rows)):
            others = np.flatnonzero((block != block[k]) | (tile[1] == tile[2]))
            gap = p[k] - p[others]
            sums[k, others] += (gap * gap // p[others]).sum(1)
        rows = []

    def out():
        lang = tile[0]
        pairs = [(names[a][1], names[b][1], int(sums[a, b])) for a in range(len(names)) for b in range(len(names)) if a != b and (tile[1] == tile[2] or names[a][0] != names[b][0])]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(pairs), pa.string()), pa.array([x for x, _, _ in pairs], pa.string()), pa.array([x for _, x, _ in pairs], pa.string()), pa.array([x for _, _, x in pairs], pa.int64())],
            ["lang", "source", "item", "value"],
        )

    for batch in batches:
        columns = [batch.column(c) for c in ("lang", "low", "high", "slab", "chunk", "block", "source", "size", "total")]
        packed = batch.column("packed")
        for k, (lang, low, high, slab, piece, block, source, size, total) in enumerate(zip(*(c.to_pylist() for c in columns))):
            here = (lang, low, high, slab)
            if rows and (here, piece) != (tile, chunk):
                add()
            if here != tile:
                if tile is not None:
                    yield out()
                tile, sums = here, None
            chunk = piece
            own = packed[k].values
            term, n = (own.field("idx").to_numpy(), own.field("n").to_numpy()) if own is not None else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            rows.append((block, source, size, total, term, n))
    if rows:
        add()
    if tile is not None:
        yield out()


def _pairs(groups: DataFrame, kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """lang, source, item, value for all two groups(lang, source, v, total, blocks) of a language, but for languages without terms.

    Groups fall into blocks by a hash. A group's packed counts of a chunk go to
    each tile of two blocks that its own is one of; a tile's chunks are read one
    after the other, so a task holds one chunk of two blocks' groups at a time.
    Slabs of chunks are tasks of their own, and what they give is summed.
    """
    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("idx", "n")).alias("packed"))  # a chunk's terms only
    vectors = groups.join(chunks, "lang").join(packed, ["lang", "source", "chunk"], "left").withColumn("packed", F.coalesce("packed", F.array().cast("array<struct<idx: int, n: bigint>>")))
    vectors = vectors.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    tiles = vectors.select("*", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")).select(
        "lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.floor(F.col("chunk") / SLAB).cast("int").alias("slab"), "chunk", "block", "source", "size", "total", "packed"
    )
    key = ("lang", "low", "high", "slab")
    return tiles.repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank over docs(text, lang, source); nulls count as ''.

    Terms are runs of letters of ASCII, in lower case, and of all characters
    beyond ASCII; a language keeps the V terms that ``least`` of its rows hold. In a group
    of a lang and source, or a lang, a kept term that occurs count times has the
    share p = 1 + floor(SCALE * (count + 1) / (N + V)), N being all such counts.
    Part ``pair``: for each other source of the lang, the sum of
    floor((p - q)² / q) over its kept terms, q the other's share; 0 without
    terms. Part ``term``: the ``listed`` terms of the group whose shares exceed
    the lang's by most, in the same measure. rank counts from 1 by falling value, then
    item. Repeated rows count as often as they occur; an empty table gives none.

    Counts are summed in tasks before they are shuffled by lang, source and
    term; what is kept for a (lang, source) is dealt by terms, so that one that
    holds a third of all rows is no task's own. All arithmetic is of integers.
    """
    short_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    groups = counts.filter("term is null").select("lang", "source")
    terms = counts.filter("term is not null")
    vocabulary = materialize(terms.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term", "all"), "vocabulary", light=True)
    langs = materialize(vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all_n")).withColumn("chunks", F.ceil(F.col("v") / CHUNK).cast("int")), "langs", light=True)
    within = vocabulary.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks").cast("int"))
    placed = materialize(within.withColumn("idx", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).select("lang", "term", "all", "v", "all_n", "chunk", "idx"), "placed", light=True)
    kept = materialize(terms.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "kept", light=True)

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    every = groups.join(blocks, "lang").join(langs.select("lang", "v"), "lang", "left").join(sizes, ["lang", "source"], "left")
    every = materialize(every.select("lang", "source", "blocks", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("own", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total")), "groups", light=True)
    chunks = placed.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size"))
    some = _pairs(every.filter("v > 0"), kept, chunks)
    bare = every.filter("v = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = some.unionByName(none).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = _share(F.col("n"), F.col("total")), _share(F.col("all"), F.col("all_n") + F.col("v"))
    over = kept.join(every.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    top = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
