"""Graph operators over edges(subject_id, predicate, object_id, chunk_ids, support, confidence) and nodes(id, name, type).

Paths are joins, one a hop, from few anchors outwards: the anchors' edges are
found first, so each join's left side is what the hop before has left. Edges of
one relation are a filter on predicate, which prunes partitions if the table is
partitioned by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import if_small, materialize, numbered
from quillgraph.schemas import closed


def collapse(facts: DataFrame) -> DataFrame:
    """Edges from facts(subject_id, predicate, object_id, chunk_id, confidence, ord), loops left out.

    chunk_ids: the ascending distinct evidence. confidence: high if any fact's
    is, else that of the first by ord.
    """
    kept = facts.filter("subject_id <> object_id")
    high = F.max(F.when(F.col("confidence") == "high", 1).otherwise(0)) == 1
    ids = F.sort_array(F.collect_set("chunk_id"))
    return kept.groupBy("subject_id", "predicate", "object_id").agg(
        ids.alias("chunk_ids"), F.when(high, "high").otherwise(F.min_by("confidence", "ord")).alias("confidence")
    ).withColumn("support", F.size("chunk_ids").cast("long"))


def resolve_endpoints(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """relations(subject, subject_type, predicate, object, object_type, …) with subject_id and object_id from aliases(surface, type, id); null where unknown.

    Of ids with one surface and type the last by id's ``ord`` wins.
    """
    last = aliases.groupBy("surface", "type").agg(F.max_by("id", "ord").alias("id"))
    s = last.select(F.col("surface").alias("subject"), F.col("type").alias("subject_type"), F.col("id").alias("subject_id"))
    o = last.select(F.col("surface").alias("object"), F.col("type").alias("object_type"), F.col("id").alias("object_id"))
    return relations.join(s, ["subject", "subject_type"], "left").join(o, ["object", "object_type"], "left")


def discarded(resolved: DataFrame) -> DataFrame:
    """reason, n of the relations that give no edge."""
    reason = F.when(F.col("subject_id").isNull() | F.col("object_id").isNull(), "unresolved_endpoint").when(F.col("subject_id") == F.col("object_id"), "self_loop_after_resolution")
    return resolved.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def merge_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Upsert: new rows replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, full_refresh: bool = False) -> DataFrame:
    """Upsert by (subject, predicate, object): evidence is united, confidence is the new one's where there is one.

    New edges need both ends in nodes. Evidence only ever grows, unless
    full_refresh drops what is old.
    """
    ends = nodes.select("id")
    valid = new.join(ends, F.col("subject_id") == ends["id"], "left_semi").join(ends, F.col("object_id") == ends["id"], "left_semi")
    if full_refresh:
        return valid
    both = old.withColumn("batch", F.lit(0)).unionByName(valid.withColumn("batch", F.lit(1)))
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list("chunk_ids"))))
    merged = both.groupBy("subject_id", "predicate", "object_id").agg(ids.alias("chunk_ids"), F.max_by("confidence", "batch").alias("confidence"))
    return merged.withColumn("support", F.size("chunk_ids").cast("long"))


def merge_passages(old: DataFrame, new: DataFrame, vectors: list[str], key: str = "chunk_id") -> DataFrame:
    """Upsert of passages: the new row's metadata, the old row's vectors; rows of one side alone stay."""
    o, n = old.alias("o"), new.alias("n")
    columns = [c if c == key else (F.col(f"o.{c}") if c in vectors else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in old.columns]
    return o.join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full").select(*columns)


def paths(edges: DataFrame, anchors: DataFrame, chain: list[str], allowed, per_anchor: int = 200, tasks: int | None = None, small: tuple[str, ...] = ()) -> DataFrame:
    """anchor, node_1…node_n, total_support, min_support, rank: directed walks along a chain of relations.

    No edge repeats within a walk; nodes may. The strongest per_anchor walks of
    each anchor by summed support, ties by the nodes' ids.

    Where no relation comes twice, walks are counted before they are made: how
    many tails of what support a first node has tells which first nodes, at
    which total, can still be among an anchor's strongest, and only their tails are met.
    tasks: over how many a hop is dealt, by its edges, where that should not be
    left to the shuffle partitions. small: relations whose edges may go to every task.
    """

    def hop(k: int) -> DataFrame:
        return edges.filter(F.col("predicate") == closed(chain[k - 1], allowed)).select(
            F.col("subject_id").alias(f"node_{k - 1}"), F.col("object_id").alias(f"node_{k}"), F.coalesce("support", F.lit(1)).cast("long").alias(f"support_{k}")
        )

    def met(walk: DataFrame, k: int) -> DataFrame:
        if chain[k - 1] in small:
            return walk.join(F.broadcast(hop(k)), f"node_{k - 1}")
        return walk.join(_dealt(hop(k), tasks, f"node_{k - 1}"), f"node_{k - 1}")

    supports, nodes = [f"support_{k}" for k in range(1, len(chain) + 1)], [f"node_{k}" for k in range(1, len(chain) + 1)]
    walk = met(anchors.select(F.col("id").alias("anchor"), F.col("id").alias("node_0")), 1)
    if len(set(chain)) == len(chain) > 1:
        tails = _dealt(hop(2), tasks, "node_1")
        for k in range(3, len(chain) + 1):
            tails = met(tails, k)
        rest = reduce(Column.__add__, map(F.col, supports[1:]))
        counts = tails.select("node_1", rest.alias("rest")).groupBy("node_1", "rest").agg(F.count("*").alias("n"))
        sums = _dealt(walk, tasks, "node_1").join(counts, "node_1").withColumn("total", F.col("support_1") + F.col("rest"))
        # walks up to those of one first node and total, and these alone; edges of the same ends count together
        upto = F.sum("n").over(Window.partitionBy("anchor").orderBy(F.desc("total"), "node_1"))
        own = F.sum("n").over(Window.partitionBy("anchor", "total", "node_1"))
        walk = sums.withColumns({"upto": upto, "own": own}).filter(F.col("upto") - F.col("own") < per_anchor).select("anchor", "node_1", "support_1", "rest")
        # equal supports are asked for as a range, as a key of their own would deal all tails anew
        tails = tails.withColumns({"first": F.col("node_1"), "tail": rest}).drop("node_1")
        walk = _dealt(walk, tasks, "node_1").join(tails, (F.col("node_1") == F.col("first")) & (F.col("tail") >= F.col("rest")) & (F.col("tail") <= F.col("rest")))
    else:
        for k in range(2, len(chain) + 1):
            walk = met(walk, k)
            for j in range(1, k):
                if chain[j - 1] == chain[k - 1]:
                    walk = walk.filter((F.col(f"node_{j - 1}") != F.col(f"node_{k - 1}")) | (F.col(f"node_{j}") != F.col(f"node_{k}")))
    walk = walk.withColumns({"total_support": reduce(Column.__add__, map(F.col, supports)), "min_support": F.col(supports[0]) if len(supports) == 1 else F.least(*supports)})
    order = Window.partitionBy("anchor").orderBy(F.desc("total_support"), *nodes)
    return walk.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= per_anchor).select("anchor", *nodes, "total_support", "min_support", "rank")


def _dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys over so many tasks; as they are if that is left open."""
    return rows.repartition(tasks, *keys) if tasks else rows


def neighbourhood(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor, outbound, neighbour and the edge in its stored direction, for every edge that touches an anchor; a loop once."""
    a = anchors.select(F.col("id").alias("anchor"))
    out = edges.join(a, F.col("subject_id") == F.col("anchor")).withColumns({"outbound": F.lit(True), "neighbour": F.col("object_id")})
    back = edges.filter("subject_id <> object_id").join(a, F.col("object_id") == F.col("anchor")).withColumns({"outbound": F.lit(False), "neighbour": F.col("subject_id")})
    return out.unionByName(back)


def neighbourhood_counts(edges: DataFrame, anchors: DataFrame, nodes: DataFrame, examples: int = 8, cites: int | None = None) -> DataFrame:
    """anchor, predicate, outbound, n, examples, chunk_ids: exact counts of distinct neighbour names, the first names in order, all evidence, or the first ``cites`` ids of it.

    Names are made distinct by a group-by of their own, so a hub's names are dealt
    over tasks, then counted; the first ones are ranked with a limit in each
    task. Evidence is gathered whole only where no ``cites`` is given.
    """
    group = ["anchor", "predicate", "outbound"]
    touching = neighbourhood(edges, anchors).select(*group, "neighbour", "chunk_ids")
    named = materialize(touching.join(nodes.select(F.col("id").alias("neighbour"), "name"), "neighbour").select(*group, "name", "chunk_ids"), "named", light=True)
    names = named.filter("name is not null").select(*group, "name").distinct()
    n = names.groupBy(*group).agg(F.count("*").alias("n"))
    first = names.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("name"))).filter(F.col("place") <= examples)
    shown = first.groupBy(*group).agg(F.sort_array(F.collect_list("name")).alias("examples"))
    cited = named.select(*group, F.explode("chunk_ids").alias("chunk_id")).distinct()
    if cites is not None:
        cited = cited.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("chunk_id"))).filter(F.col("place") <= cites)
    cited = cited.groupBy(*group).agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    found = named.select(*group).distinct().join(n, group, "left").join(shown, group, "left").join(cited, group, "left")
    kinds = dict(named.dtypes)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return found.select(*group, F.coalesce("n", F.lit(0)).alias("n"), none("examples", f"array<{kinds['name']}>"), none("chunk_ids", kinds["chunk_ids"]))


#: Objects of a subject that meet in one task; longer lists are cut into blocks that meet two by two.
BLOCK = 512
#: Objects, those with most subjects, whose pairs are counted first, as a multiple of the pairs wanted.
LEAD = 4
#: Pairs that make a task's work, where they are listed and where they are counted; tasks that either is dealt over at most.
LISTED, COUNTED, MOST_LISTING, MOST_COUNTING = 2_000_000, 1_000_000, 1_000, 10_000
#: Subjects from which on an object's pairs are dealt over several tasks.
BUSY = 4096


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """subject_id, a, b with a < b from left(subject_id, a) and right(subject_id, b).

    Both lists of a subject fall into blocks of about BLOCK by a hash; each block
    of one goes to each of the other, so a hub is as many tasks' work as it has pairs of blocks.
    """
    n = left.groupBy("subject_id").agg(F.count("*").alias("left_n")).join(right.groupBy("subject_id").agg(F.count("*").alias("right_n")), "subject_id")
    cut = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    blocks = materialize(n.select("subject_id", cut("left_n").alias("rows"), cut("right_n").alias("columns")), "blocks", light=True)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    l = left.join(blocks, "subject_id").select("subject_id", "a", F.pmod(F.xxhash64("a"), "rows").cast("int").alias("row"), every("columns").alias("column"))
    r = right.join(blocks, "subject_id").select("subject_id", "b", F.pmod(F.xxhash64(F.lit(1), "b"), "columns").cast("int").alias("column"), every("rows").alias("row"))
    return l.join(r, ["subject_id", "row", "column"]).filter("a < b").select("subject_id", "a", "b")


def _pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n: for a < b how many subjects links(subject_id, o, first) has with both, where a is ``first`` in its links; o are whole numbers.

    A subject's objects are one list, a long one blocks that meet two by two as
    in `_met`. Each object goes to its task with the lists that it is in, so that
    a pair takes a number's bytes of the shuffle and is counted where it is made.
    """
    sizes = links.groupBy("subject_id").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts"))
    sizes = materialize(sizes.filter("firsts > 0"), "sizes", light=True)
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("firsts")) / 2, F.lit(0.0))).first()[0]
    tasks = lambda each, most: int(max(1, min(most, pairs // each)))  # noqa: E731 - said outright, as few links may give many pairs
    cut = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    long = materialize(sizes.filter(F.col("n") > BLOCK).select("subject_id", cut("firsts").alias("rows"), cut("n").alias("columns")), "blocks", light=True)
    busy = materialize(links.groupBy("o").agg(F.count("*").alias("n")).filter(F.col("n") > BUSY).select(F.col("o").alias("a"), F.ceil(F.col("n") / BUSY).cast("int").alias("parts")), "busy", light=True)

    tile = lambda row, column, own, other: F.struct(row.alias("row"), column.alias("column"), own.alias("own"), other.alias("other"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(0)
    row, column = F.pmod(F.xxhash64("o"), "rows").cast("int"), F.pmod(F.xxhash64(F.lit(1), "o"), "columns").cast("int")
    own = F.when(F.col("first"), F.transform(F.sequence(none, F.col("columns") - 1), lambda c: tile(row, c, yes, no)))
    other = F.transform(F.sequence(none, F.col("rows") - 1), lambda r: tile(r, column, no, yes))
    tiles = F.when(F.col("columns").isNull(), F.array(tile(none, none, F.col("first"), yes))).when(F.col("first"), F.concat(own, other)).otherwise(other)
    placed = links.join(if_small(long), "subject_id", "left").select("subject_id", "o", F.explode(tiles).alias("t")).select("subject_id", "t.row", "t.column", "o", "t.own", "t.other")
    lists = placed.repartition(tasks(LISTED, MOST_LISTING), "subject_id", "row", "column").groupBy("subject_id", "row", "column")
    lists = lists.agg(F.collect_list(F.when(F.col("own"), F.col("o"))).alias("own"), F.collect_list(F.when(F.col("other"), F.col("o"))).alias("others"))
    after = lists.select(F.explode("own").alias("a"), "others").select("a", F.filter("others", lambda b: b > F.col("a")).alias("others")).filter(F.size("others") > 0)

    share = lambda part, others: F.struct(part.alias("part"), others.alias("others"))
    shares = F.when(F.col("parts").isNull(), F.array(share(none, F.col("others")))).otherwise(F.transform("others", lambda b: share(F.pmod(F.xxhash64(b), "parts").cast("int"), F.array(b))))
    dealt = after.join(if_small(busy), "a", "left").select("a", F.explode(shares).alias("s")).select("a", "s.part", "s.others").repartition(tasks(COUNTED, MOST_COUNTING), "a", "part")
    return dealt.select("a", "part", F.explode("others").alias("b")).groupBy("a", "part", "b").agg(F.count("*").alias("n")).select("a", "b", "n")


def shared_neighbour(edges: DataFrame, predicate: str, allowed, most: int, examples: int = 3) -> DataFrame:
    """a, b, n, examples: pairs of objects of one relation by the subjects that they share, the most shared first, then by a and b.

    Exact, without counting all pairs. Two objects share no more subjects than
    either has. So pairs among those that have most are counted first; the last
    of the best ``most`` of them bounds what can still come before it: objects
    with as many subjects at least, and of objects with just as many only pairs
    that come before it in order. Pairs aren't shuffled one by one: objects
    meet the lists that they are in (`_pair_counts`). examples are a pair's first
    subjects, of which no task holds more than it shows.
    """
    e = materialize(edges.filter(F.col("predicate") == closed(predicate, allowed)).select("subject_id", "object_id").distinct(), "links", light=True)
    # an object without company in any subject is in no pair
    company = e.groupBy("subject_id").agg(F.count("*").alias("n")).filter("n > 1").select("subject_id")
    e = e.join(company, "subject_id", "left_semi")
    degree = materialize(e.groupBy("object_id").agg(F.count("*").alias("degree")), "degrees", light=True)
    head = degree.orderBy(F.desc("degree"), "object_id").limit(LEAD * most + 2).select("object_id")
    few = e.join(F.broadcast(head), "object_id", "left_semi")

    def ranked(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(most), "top", light=True)

    def sides(of: DataFrame) -> tuple[DataFrame, DataFrame]:
        return of.withColumnRenamed("object_id", "a"), of.withColumnRenamed("object_id", "b")

    lead = ranked(_met(*sides(few)))
    last = lead.orderBy("n", F.desc("a"), F.desc("b")).first() if lead.count() == most else None
    # numbers in the order of the objects stand for them while pairs are counted
    places = materialize(numbered(degree if last is None else degree.filter(F.col("degree") >= last.n), ["object_id"]), "places", light=True)
    kind = "int" if places.count() < 1 << 31 else "long"
    first, before = F.lit(True), F.lit(True)
    if last is not None:
        at = {r.object_id: r.place for r in places.filter(F.col("object_id").isin(last.a, last.b)).collect()}
        a, b = at[last.a], at[last.b]
        first = (F.col("degree") > last.n) | (F.col("place") <= a)
        before = (F.col("n") > last.n) | (F.col("n") == last.n) & ((F.col("a") < a) | (F.col("a") == a) & (F.col("b") <= b))
    known = materialize(e.join(places, "object_id").select("subject_id", F.col("place").cast(kind).alias("o"), first.alias("first")), "numbered", light=True)
    best = materialize(_pair_counts(known).filter(before).orderBy(F.desc("n"), "a", "b").limit(most), "best", light=True)
    name = lambda c: F.broadcast(best.select(c).distinct()).join(places.select(F.col("place").cast(kind).alias(c), F.col("object_id").alias(f"{c}_id")), c)
    top = materialize(best.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "n"), "top", light=True)
    ends = top.select(F.explode(F.array("a", "b")).alias("object_id")).distinct()  # twice ``most`` at most
    shown = _met(*sides(e.join(F.broadcast(ends), "object_id", "left_semi"))).join(F.broadcast(top.select("a", "b")), ["a", "b"])
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("subject_id"))
    first = shown.withColumn("place", place).filter(F.col("place") <= examples)
    return top.join(first.groupBy("a", "b").agg(F.sort_array(F.collect_list("subject_id")).alias("examples")), ["a", "b"])


def pattern_three_hop(edges: DataFrame, first: str, second: list[str], third: list[str], allowed, most: int) -> DataFrame:
    """start, a, b, c: start-[first]->a-[any of second]->b<-[any of third]-c with a, b, c different; the first by name."""
    for p in (first, *second, *third):
        closed(p, allowed)
    e1 = edges.filter(F.col("predicate") == first).select(F.col("subject_id").alias("start"), F.col("object_id").alias("a"))
    e2 = edges.filter(F.col("predicate").isin(second)).select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.col("predicate").alias("p2"))
    e3 = edges.filter(F.col("predicate").isin(third)).select(F.col("object_id").alias("b"), F.col("subject_id").alias("c"), F.col("predicate").alias("p3"))
    found = e1.join(e2, "a").filter("a <> b").join(e3, "b").filter("c <> a and c <> b and (p2 <> p3 or a <> c)")
    return found.select("start", "a", "p2", "b", "p3", "c").orderBy("start", "a", "p2", "b", "p3", "c").limit(most)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches; one with a loop alone is touched."""
    ends = edges.select(F.col("subject_id").alias("id")).unionByName(edges.select(F.col("object_id").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def counts_by_relation(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """predicate, n for every relation of the vocabulary, those without edges too."""
    n = edges.groupBy("predicate").agg(F.count("*").alias("n"))
    return F.broadcast(vocabulary.select("predicate")).join(n, "predicate", "left").select("predicate", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_loops, n_orphans, orphan_rate (0 for no nodes)."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("subject_id") == F.col("object_id")).alias("n_loops"))
    o = orphans(nodes, edges).agg(F.count("*").alias("n_orphans"))
    one = F.lit(1).alias("one")
    joined = n.withColumn("one", one).join(e.withColumn("one", one), "one").join(o.withColumn("one", one), "one").drop("one")
    return joined.withColumn("orphan_rate", F.round(F.coalesce(F.try_divide("n_orphans", "n_nodes"), F.lit(0.0)), 6))


def chunk_entities(entities: DataFrame) -> DataFrame:
    """chunk_id, entity_ids (ascending) from entities(canonical_id, mention_chunks)."""
    pairs = entities.select("canonical_id", F.explode("mention_chunks").alias("chunk_id")).distinct()
    return pairs.groupBy("chunk_id").agg(F.sort_array(F.collect_list("canonical_id")).alias("entity_ids"))


def store_rows(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Passages with the entities that they mention; none is an empty array."""
    return chunks.join(chunk_entities(entities), "chunk_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def join_key_check(store: DataFrame, edges: DataFrame, least: int = 2, sample: int = 20) -> DataFrame:
    """One row: sampled, joined - of the first passages with more than ``least`` entities, those that some edge cites."""
    chosen = store.filter(F.size("entity_ids") > least).orderBy("chunk_id").limit(sample).select("chunk_id")
    cited = edges.select(F.explode("chunk_ids").alias("chunk_id")).distinct().withColumn("hit", F.lit(1))
    return chosen.join(cited, "chunk_id", "left").agg(F.count("*").alias("sampled"), F.count("hit").alias("joined"))


def passages(ids: list[str] | DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages of ids(ids array) in the order of the ids; those that chunks lacks are left out."""
    wanted = ids if isinstance(ids, DataFrame) else chunks.sparkSession.createDataFrame([(ids,)], "ids array<string>")
    return wanted.select(F.posexplode("ids").alias("pos", "chunk_id")).join(chunks, "chunk_id").orderBy("pos")


def gate(one_row: DataFrame, **most: float) -> list[str]:
    """Names of the measures of a one-row report that lie above their limits."""
    row = one_row.first()
    return [k for k, v in most.items() if row[k] > v]
