"""Near duplicates by the Jaccard similarity of word shingles: SimHash and BK-trees link the nearest, a prefix filter finds all others."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import simhash
from quillgraph.llm.common import documents, raw
from quillgraph.operators.components import connected_components
from quillgraph.runtime import discard, if_small, materialize, settled

#: The least similarity, as a fraction of whole numbers: 4/5.
OVER, UNDER = 4, 5
#: Common shingles are told by about SAMPLE texts, at most COMMON of them; they only order shingles, which decides the cost but no result.
SAMPLE, COMMON = 20_000, 200_000
#: Pairs whose sketches a task compares at once.
HOLD = 1 << 18
#: Bits of a sketch; larger sets have a wide one too.
BITS = 1024
#: Bits in which fingerprints may differ that BK-trees look for.
RADIUS = 4
#: Texts of one shingle that a task holds; of more, each two tiles of this size are compared.
TILE = 4096
#: Shared shingles of a text that go with it, so that a pair of texts that share several is found at the first of them alone.
LOWEST = 16


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    return np.unique(simhash.shingle_hashes(text, width))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """If two sets have the similarity; sets of no shingles are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def sketch(shingles: np.ndarray, bits: int = BITS) -> bytes:
    """The parity of how many shingles fall on each bit: two sets differ in at least as many shingles as their sketches in bits."""
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def wide(shingles: np.ndarray) -> bytes:
    """A sketch of at least a bit for each shingle, as BITS can't tell sets of twice as many apart; empty for sets of up to BITS."""
    return sketch(shingles, 1 << (len(shingles) - 1).bit_length()) if len(shingles) > BITS else b""


def wide_alike(a: bytes, b: bytes, sizes: int) -> bool:
    """If wide sketches of sets of so many shingles together allow the similarity; the larger one is folded to the bits of the other."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    if not len(x) or not len(y):
        return True
    while len(x) != len(y):
        x, y = (z[: len(z) // 2] ^ z[len(z) // 2 :] if len(z) > len(other) else z for z, other in ((x, y), (y, x)))
    return (UNDER + OVER) * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= (UNDER - OVER) * sizes


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, common ones last, of which similar sets share one at least."""
    size = len(shingles)
    most = size + (-OVER * size // UNDER) + 1 if size else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        known = common[at] == shingles
        shingles = np.concatenate((shingles[~known], shingles[known][np.argsort(rank[at[known]])]))
    return shingles[:most]


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about SAMPLE texts have, ascending, and their places by frequency."""
    every = max(1, texts.count() // SAMPLE)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in raw(batch.column("text"))]
            found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counts = texts.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("text").mapInArrow(run, "shingle long, n long")
    top = counts.groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingles = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], (len(shingles) - np.arange(len(shingles)))[order]


def _firsts(texts: DataFrame, width: int) -> DataFrame:
    """node, size, sketch, wide (sketch), fp (the SimHash), firsts (the prefix, 8 bytes a shingle) of each text's set."""
    model = texts.sparkSession.sparkContext.broadcast(_common(texts, width))

    def run(batches):
        for batch in batches:
            hashes = [simhash.shingle_hashes(t, width) for t in raw(batch.column("text"))]
            sets = [np.unique(x) for x in hashes]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([sketch(x) for x in sets], pa.binary()),
                    pa.array([wide(x) for x in sets], pa.binary()),
                    pa.array(np.array([simhash.print_of(x) for x in hashes], np.uint64).view(np.int64)),
                    pa.array([prefix(x, *model.value).tobytes() for x in sets], pa.binary()),
                ],
                ["node", "size", "sketch", "wide", "fp", "firsts"],
            )

    return materialize(texts.mapInArrow(run, "node long, size int, sketch binary, wide binary, fp long, firsts binary"), "firsts")


def _close(nodes: DataFrame) -> DataFrame:
    """u, v: pairs of nodes(node, fp) of equal or close fingerprints that join all such nodes."""
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "prints", light=True)
    twins = nodes.join(prints, "fp").filter("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    first, second = (prints.select(F.col("fp").alias(c), F.col("lead").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    linked = simhash.links(prints.select("fp"), RADIUS).join(first, "u").join(second, "v")
    return twins.unionByName(linked.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def _members(firsts: DataFrame) -> DataFrame:
    """shingle, node, size, leader for the prefixes' shingles by which several nodes may be similar.

    A pair's first common shingle is at a place in each set that leaves room for
    all the others, so a node's place there bounds the other's size (``cap``).
    Nodes of a shingle are taken by size, and a chain ends where none so far
    reaches up to the next one; ``shingle`` names a chain, and chains of one node
    go. leader is the node that each is compared with first: the first of those
    in its chain of about its size, or for that one the node before it.
    """

    def prefixes(batches):
        for batch in batches:
            found = batch.column("firsts").to_pylist()
            n = np.array([len(x) // 8 for x in found], np.int64)
            node, size = batch.column("node").to_numpy(), np.repeat(batch.column("size").to_numpy(), n).astype(np.int64)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [packed(np.frombuffer(b"".join(found), np.int64), size, most_size(size, place)), np.repeat(node, n), size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shingle", "node", "size"])

    rows = firsts.select("node", "size", "firsts").mapInArrow(prefixes, "shingle long, node long, size int")
    shingle = F.col("shingle").bitwiseAND(~15)
    dealt = rows.repartition(shingle).sortWithinPartitions(shingle, "size", "node")
    return dealt.mapInArrow(_led, "shingle long, node long, size int, leader long")


def most_size(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The size of the largest set that is similar to one of a size, if the first shingle that both have is at a place of its order."""
    return (UNDER + OVER) * (size - place) // OVER - size


def packed(shingle: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Shingles whose last four bits say in 32nds of its size how far a set reaches, rounded up; a column of its own would make each row a third longer to shuffle."""
    return (shingle & ~15) | (-((size - most) * 32 // np.maximum(size, 1)) + 7)


def unpacked(shingle: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles without those bits, and the greatest sizes."""
    return shingle & ~15, size + ((shingle & 15) - 7) * size // 32


def _chains(batches):
    """(chain, node, size) arrays of `packed` rows(shingle, node, size) that come by shingle, size and node; those that reach none before or after are left out."""
    last, top, low, name = None, -1, 0, 0  # of the row before: shingle and node, the shingle's greatest cap, its chain's least size and name
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, node, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "node", "size"))
        shingle, cap = unpacked(shingle, size)
        rows = np.stack((shingle, node, size, cap))
        twin = (rows[:2] == np.concatenate((rows[:2, :1] if last is None else last, rows[:2, :-1]), 1)).all(0)
        twin[0] &= last is not None
        rows = rows[:, ~twin]
        if not rows.shape[1]:
            continue
        shingle, node, size, cap = rows
        start = np.concatenate(([last is None or last[0, 0] != shingle[0]], shingle[1:] != shingle[:-1]))
        if not start[0]:
            cap[0], own = max(cap[0], top), cap[0]  # for what the shingle's rows after it see
        reach = np.maximum.accumulate(cap + (np.cumsum(start) << 33)) - (np.cumsum(start) << 33)
        before = np.concatenate(([top], reach[:-1]))
        if not start[0]:
            cap[0] = own
        new = start | (before < size)
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        least = np.where(first < 0, low, size[first])
        chain = np.where(first < 0, name, np.where(start[first], shingle[first], shingle[first] ^ (node[first] * np.int64(0x1E3779B97F4A7C15))))
        last, top, low, name = rows[:2, -1:], reach[-1], least[-1], chain[-1]
        good = cap >= least
        yield chain[good], node[good], size[good]


def _led(batches):
    """Batches of shingle (the chain), node, size, leader of chains of several nodes."""

    def out(rows, leader):
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), pa.array(leader)], ["shingle", "node", "size", "leader"])

    # the last row waits for the next batch, as only that tells if it is alone
    last, head, leader, alone = np.zeros((3, 0), np.int64), 0, 0, True
    for found in _chains(batches):
        held = last.shape[1] > 0
        rows = np.concatenate((last, np.stack(found)), 1)
        if rows.shape[1] == held:
            continue
        about = np.floor(np.log(rows[2]) / np.log(UNDER / OVER))
        new = np.concatenate(([alone], rows[0, 1:] != rows[0, :-1]))
        part = new | np.concatenate(([True], about[1:] != about[:-1]))
        heads = rows[1, np.maximum.accumulate(np.where(part, np.arange(rows.shape[1]), 0))]
        if held:
            heads[np.cumsum(part) == 1] = head
        led = np.where(part & ~new, np.concatenate((rows[1, :1], rows[1, :-1])), heads)
        if held:
            led[0] = leader
        keep = ~(new & np.concatenate((new[1:], [True])))
        keep[-1] = False
        last, head, leader, alone = rows[:, -1:], heads[-1], led[-1], bool(new[-1])
        yield out(rows[:, keep], led[keep])
    if not alone:
        yield out(last, np.array([leader]))


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs(u, v) whose sizes and sketches allow the similarity."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("a", "b"))
            least, most = batch.column("least").to_numpy(), batch.column("most").to_numpy()
            yield batch.select(["u", "v"]).filter(pa.array((UNDER * least >= OVER * most) & _alike(a, b, least + most)))

    first, second = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    both = pairs.join(first, "u").join(second, "v").select("u", "v", F.least("size_u", "size_v").alias("least"), F.greatest("size_u", "size_v").alias("most"), "a", "b")
    return both.mapInArrow(run, "u long, v long")


def _alike(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """If sketches of sets of so many shingles together allow the similarity."""
    return (UNDER + OVER) * np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= (UNDER - OVER) * sizes.astype(np.int64)


def _wider(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs(u, v) whose wide sketches, where both sets have one, allow the similarity too."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sizes")))
            yield batch.select(["u", "v"]).filter(pa.array([a is None or b is None or wide_alike(a, b, n) for a, b, n in rows], pa.bool_()))

    large = nodes.filter(F.col("size") > BITS)
    first, second = (large.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("wide").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    both = pairs.join(first, "u", "left").join(second, "v", "left").select("u", "v", "a", "b", (F.col("size_u") + F.col("size_v")).alias("sizes"))
    return both.mapInArrow(run, "u long, v long")


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs(u, v) of similar sets, which are made again from the texts for the pairs that no wide sketch rules out."""

    def sets_of(batches):
        seen: set[int] = set()  # of wanted nodes: a task passes each on once
        for batch in batches:
            fresh = [n for n, node in enumerate(batch.column("node").to_pylist()) if not (node in seen or seen.add(node))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            found = [shingle_set(t, width).tobytes() for t in raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            good = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["u", "v"]).filter(good)

    left = materialize(_wider(pairs, nodes), "near")
    ends = {c: materialize(left.select(F.col(c).alias("node")).distinct(), "ends", light=True) for c in ("u", "v")}
    wanted = materialize(ends["u"].union(ends["v"]).distinct(), "wanted", light=True)
    sets = materialize(texts.join(if_small(wanted), "node", "left_semi").mapInArrow(sets_of, "node long, shingles binary"), "sets")
    if sets.count() > wanted.count():  # equal texts in several tasks
        sets = materialize(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    first, second = (sets.join(if_small(ends[c]), "node", "left_semi").select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    return left.join(first, "u").join(second, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v: pairs of members(shingle, class, node, size) of one shingle, of unlike classes, whose sizes and sketches allow the similarity.

    Sketches are compared where a shingle's members meet, and a pair leaves the
    task of the least shingle that both have, if that is among the LOWEST least of
    both (else, which is rare, of several). The members of a shingle that more
    than TILE have are cut by a hash into tiles, and each two tiles are compared,
    so no task holds all.
    """

    def pairs(shingle, a, b, own, nodes, classes, sizes, sketches, lowest):
        own, nodes, classes, sizes = (np.array(x) for x in (own, nodes, classes, sizes))
        if classes[0] == classes[-1]:
            return
        bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, BITS // 64)
        before = [frozenset(x[: bisect_left(x, shingle)]) for x in lowest]
        for at in range(len(nodes)):
            # rows come by class, so the later ones of another class are a range
            low = int(np.searchsorted(classes, classes[at], "right"))
            for start in range(low, len(nodes), HOLD):
                stop = min(start + HOLD, len(nodes))
                fit = (UNDER * sizes[start:stop] >= OVER * sizes[at]) & (UNDER * sizes[at] >= OVER * sizes[start:stop])
                if a != b:
                    fit &= own[start:stop] != own[at]
                others = start + np.flatnonzero(fit)
                others = others[_alike(bits[at], bits[others], sizes[others] + sizes[at])]
                others = [n for n in others.tolist() if before[at].isdisjoint(before[n])]
                if others:
                    yield nodes[at], nodes[others]

    def rows(found):
        out, n = [], 0
        for u, v in found:
            out.append((np.minimum(u, v), np.maximum(u, v)))
            n += len(v)
            if n > HOLD:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["u", "v"])
                out, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["u", "v"])

    def groups(batches):
        key, held = None, [[] for _ in range(6)]
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "a", "b")])
            columns = [batch.column(c).to_pylist() for c in ("own", "node", "class", "size", "sketch", "lowest")]
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [keys.shape[1]]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (this := tuple(keys[:, low].tolist())) != key:
                    if held[0]:
                        yield from pairs(*key, *held)
                    key, held = this, [[] for _ in range(6)]
                for h, c in zip(held, columns):
                    h.extend(c[low:high])
        if held[0]:
            yield from pairs(*key, *held)

    mixed = members.groupBy("shingle").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n")).filter("least < most")
    dealt = materialize(members.join(mixed.select("shingle", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "shingle"), "mixed", light=True)
    lowest = dealt.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("shingle")), 1, LOWEST).alias("lowest"))  # of a node's prefix
    dealt = dealt.join(lowest, "node").join(nodes.select("node", "sketch"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    keys = ["shingle", "a", "b"]
    dealt = dealt.select(*keys, "own", "node", "class", "size", "sketch", "lowest").repartition(*keys).sortWithinPartitions(*keys, "class", "node")
    return dealt.mapInArrow(lambda batches: rows(groups(batches)), "u long, v long").distinct()


def _print(text: Column | str) -> Column:
    """What names a text as a node, but for clashes."""
    return F.xxhash64(text)


def _named(rows: DataFrame) -> DataFrame:
    """rows(text, …) with ``node``: a hash of the text, 0 for one without words.

    A second hash tells unlike texts of one hash apart. They are few or none;
    such texts are named by both hashes, so no text takes another one's place.
    """
    bare = F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == ""
    rows = rows.withColumns({"node": F.when(bare, F.lit(0)).otherwise(_print("text")), "other": F.when(bare, F.lit(0)).otherwise(F.xxhash64(F.lit(1), "text"))})
    clashes = rows.groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most")).filter("least < most").select("node")
    clashes = materialize(clashes, "clashes", light=True)
    if not clashes.isEmpty():
        rows = rows.join(if_small(clashes.withColumn("clash", F.lit(True))), "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64(F.lit(2), "node", "other")).otherwise(F.col("node"))).drop("clash")
    return rows.drop("other")


def near_duplicates(docs: DataFrame, width: int = 5, key: str | None = None) -> DataFrame:
    """doc_id, component_id, kept, and key if it is named, for each row of docs(doc_id, text).

    Texts whose sets of word shingles have a Jaccard similarity of OVER/UNDER or
    more link; component_id is the smallest doc_id that links reach, null if all
    ids there are null. A null text is empty; texts without words link to each
    other only. One row of a component is kept: that of the smallest doc_id, a
    null one after all others, then the first by key. key: a column that tells
    rows apart; without one, rows are numbered here.

    Texts of equal or close SimHashes, found by BK-trees, are compared. Edited
    texts are mostly farther apart than any radius that is cheap to search, so a
    prefix filter finds the others: in any order of all shingles,
    one of the first n - ceil(0.8 n) + 1 of a set of n is among those of the
    other set too, and no similar pair is missed. So that few dissimilar texts
    meet, common shingles come last. Texts that share such a shingle are at first
    compared with the smallest of them only, which joins large groups of copies by one
    pair a text and shingle; then those that are not joined yet are compared by
    their sketches. Sizes and sketches only rule out what can't be similar; the
    whole sets decide the rest.
    """
    row = F.monotonically_increasing_id() if key is None else F.col(key)
    rows = documents(docs, row.alias("row")).select("doc_id", "row", F.coalesce("text", F.lit("")).alias("text"))
    rows = _named(rows)
    texts = rows.select("node", "text")
    firsts = _firsts(texts, width)
    spark = docs.sparkSession
    members = settled(lambda: _members(firsts), spark, "members")
    nodes = settled(lambda: firsts.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "sketch", "wide", "fp"))), spark, "nodes")
    discard(firsts)
    led = members.filter("leader <> node").select(F.col("leader").alias("u"), F.col("node").alias("v"))
    star = settled(lambda: led.unionByName(_close(nodes)).distinct(), spark, "star")
    links = settled(lambda: _similar(_near(star, nodes), nodes, texts, width), spark, "similar")
    joined = settled(lambda: connected_components(links), spark, "joined")
    classes = members.select("shingle", "node", "size").join(if_small(joined), "node", "left").select("shingle", "node", "size", F.coalesce("component", "node").alias("class"))
    more = settled(lambda: _similar(_across(classes, nodes).join(star, ["u", "v"], "left_anti"), nodes, texts, width), spark, "similar")
    found = settled(lambda: connected_components(links.unionByName(more)), spark, "found")
    ids = rows.select("doc_id", "row", "node").join(found, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))
    ids = materialize(ids, "ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row"))
    names = materialize(ids.groupBy("component").agg(first.alias("first")), "names", light=True)
    return ids.join(names, "component").select(
        "doc_id", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), *([F.col("row").alias(key)] if key else [])
    )
