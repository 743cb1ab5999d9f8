"""Entity resolution: blocking, named match rules, components, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.vectors import cosine
from quillgraph.operators.components import connected_components
from quillgraph.runtime import materialize, numbered

TAU, FLOOR, BUCKET = 0.88, 0.67, 400
#: Names of a list that meet in one task; longer lists are cut into blocks that meet two by two.
LIST = 512
#: Meetings of records under a key that make a task of their own, and tasks that meetings are dealt over at most.
MEETINGS, MOST_TASKS = 200_000, 10_000


def mentions(extractions: DataFrame) -> DataFrame:
    """surface, type, norm, chunks, n, ord from extractions(row_ord, chunk_id, mentions); names without a norm go."""
    rows = extractions.select("row_ord", "chunk_id", F.posexplode("mentions").alias("pos", "m")).select("row_ord", "chunk_id", "pos", F.col("m.name").alias("surface"), F.col("m.type").alias("type"))
    grouped = rows.groupBy("surface", "type").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunks"), F.count("*").alias("n"), F.min(F.struct("row_ord", "pos")).alias("ord"))
    return grouped.withColumn("norm", X.normalize("surface")).filter("norm <> ''")


def candidates(records: DataFrame, most: int = BUCKET) -> DataFrame:
    """i < j: pairs of records(id, type, norm, surface) of one type that share a blocking key.

    Keys with more than ``most`` records are skipped: they say too little. That
    is the rule of the operator, and it bounds every bucket of the join.
    """
    return candidate_pairs(records, [], most).select("i", "j")


def _exact(norm: Column | str = "norm") -> Column:
    """The blocking key that records of one type and norm share."""
    return F.concat_ws("|", "type", F.concat(F.lit("exact:"), norm))


def candidate_pairs(records: DataFrame, carried: list[str], most: int = BUCKET, equal: bool = True) -> DataFrame:
    """`candidates` with structs a and b of the carried columns of both records.

    A pair is made under the first key alone that both records share, so it
    needs no shuffle afterwards, neither to be made distinct nor to meet its records.
    equal: False leaves out the pairs that `equals` links.
    """
    keyed = records.select("id", F.explode(F.transform(X.blocking_keys("norm", "surface"), lambda k: F.concat_ws("|", "type", k))).alias("key"))
    fair = keyed.groupBy("key").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most)).select("key")
    held = keyed.join(fair, "key", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    side = records.select("id", F.struct(*carried, F.lit(0).alias("_")).alias("r")).join(held, "id") if carried else held.withColumn("r", F.lit(0))
    kept = side.select("id", "r", "keys", F.posexplode("keys").alias("place", "key"))
    if not equal:  # a record has one such key, under which all pairs are of equal norms
        kept = side.join(records.select("id", _exact().alias("exact")), "id").withColumn("exact", F.try_element_at(F.filter("keys", lambda k: k == F.col("exact")), F.lit(1)))
        kept = kept.select("id", "r", "keys", "exact", F.posexplode("keys").alias("place", "key")).filter("exact is null or key <> exact")
    kept = materialize(kept, "keyed", light=True)
    alike = F.lit(None).cast("string") if equal else F.col("exact")
    left = kept.select("key", F.col("id").alias("i"), F.col("r").alias("a"), F.slice("keys", F.lit(1), F.col("place")).alias("before"), alike.alias("left_exact"))
    right = kept.select("key", F.col("id").alias("j"), F.col("r").alias("b"), "keys", alike.alias("right_exact"))
    n = F.col("n").cast("double")
    meetings = kept.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(n * n), F.lit(0.0))).first()[0]
    tasks = int(max(1, min(MOST_TASKS, meetings // MEETINGS)))  # said outright, as few records may give many pairs
    met = left.repartition(tasks, "key").join(right.repartition(tasks, "key"), "key").filter("i < j").filter(F.coalesce(F.col("left_exact") != F.col("right_exact"), F.lit(True))).filter((F.size("before") == 0) | ~F.arrays_overlap("before", "keys"))
    return met.select("i", "j", "a", "b")


def equals(records: DataFrame, most: int = BUCKET) -> DataFrame:
    """i, j: each of records(id, type, norm, ours, theirs) of one type and norm with the least of them, where they are no more than ``most``.

    All pairs of such records are candidates that match, unless an override says
    that the norm isn't its own like; so for classes these links say as much as the
    pairs, which grow with the square of the copies of a name.
    """
    said = F.coalesce(F.try_element_at("ours", F.col("norm")), F.try_element_at("theirs", F.col("norm")), F.lit(True))
    rows = records.filter("norm is not null").filter(said).select("id", _exact().alias("key"))
    least = rows.groupBy("key").agg(F.min("id").alias("i"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most))
    return rows.join(least, "key").filter("id <> i").select("i", F.col("id").alias("j"))


def markers(locations: DataFrame) -> DataFrame:
    """word: what marks an entity of its own: fixed places and foreign forms, and the words of the corpus's locations (a column ``norm``)."""
    fixed = locations.sparkSession.createDataFrame([(w,) for w in sorted({*X.FOREIGN_FORMS, *X.PLACES})], "word string")
    found = locations.select(F.explode(X.tokens("norm")).alias("word")).filter(~F.col("word").isin(*X.PLACE_STOPWORDS))
    return found.unionByName(fixed).distinct()


def marked(records: DataFrame, words: DataFrame) -> DataFrame:
    """records(id, norm, …) with ``marks``: which of the words(word) each one's norm has."""
    held = records.select("id", F.explode(X.tokens("norm")).alias("word")).join(words, "word").groupBy("id").agg(F.collect_set("word").alias("marks"))
    return records.join(held, "id", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<string>")))


def rule(a: str, b: str, override: Column, similarity: Column, marks: Column, tau: float | Column = TAU, floor: float = FLOOR) -> Column:
    """Name of the rule by which two records (structs a and b with norm, surface) match; null if none does.

    In order: an override, equal norms, one being the other's initials, a marker
    that only one has (no match), similar vectors and words.
    """
    an, bn, asf, bsf = (F.col(f"{t}.{c}") for c in ("norm", "surface") for t in (a, b))
    at, bt = X.tokens(an), X.tokens(bn)

    def short(x: Column, norm: Column, surface: Column) -> Column:
        return (F.length(x) >= 2) & ~x.contains(" ") & ((X.acronym(norm) == x) | (X.raw_acronym(surface) == x))

    apart = F.arrays_overlap(F.array_union(F.array_except(at, bt), F.array_except(bt, at)), marks)
    return (
        F.when(override.isNotNull(), F.when(override, "override"))
        .when(an == bn, "exact")
        .when(short(an, bn, bsf) | short(bn, an, asf), "acronym")
        .when(apart, F.lit(None).cast("string"))
        .when((similarity >= tau) & (X.jaccard(at, bt) >= floor), "embedding")
    )


def with_overrides(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """records(norm, …) with ``ours`` and ``theirs``: by the other norm, what overrides(a, b, same) say of the norm as a, and as b."""
    o = overrides.select(X.normalize("a").alias("oa"), X.normalize("b").alias("ob"), "same").filter("oa is not null and ob is not null").dropDuplicates(["oa", "ob"])
    of = lambda own, other, name: o.groupBy(F.col(own).alias("norm")).agg(F.map_from_entries(F.collect_list(F.struct(other, "same"))).alias(name))
    return records.join(of("oa", "ob", "ours"), "norm", "left").join(of("ob", "oa", "theirs"), "norm", "left")


def overridden(a: str, b: str) -> Column:
    """The override of two records (structs of `with_overrides`): that of their norms in this order, else in the other."""
    said = lambda c: F.try_element_at(F.col(f"{a}.{c}"), F.col(f"{b}.norm"))
    return F.coalesce(said("ours"), said("theirs"))


def matches(records: DataFrame, overrides: DataFrame, words: DataFrame, tau: float = TAU, floor: float = FLOOR, most: int = BUCKET) -> DataFrame:
    """i, j, rule of the matching pairs of records(id, type, norm, surface, embedding); words(word) are the markers."""
    side = with_overrides(marked(records, words), overrides)
    pairs = candidate_pairs(side, ["norm", "surface", "embedding", "marks", "ours", "theirs"], most)
    scored = pairs.withColumn("rule", rule("a", "b", overridden("a", "b"), cosine("a.embedding", "b.embedding", 1e-9), F.array_union("a.marks", "b.marks"), tau, floor))
    return scored.filter("rule is not null").select("i", "j", "rule")


def entities(records: DataFrame, matched: DataFrame) -> DataFrame:
    """canonical_id, type, name, aliases, mention_chunks, mention_count of each class of records(id, type, surface, norm, chunks, n, ord).

    The id is a hash of the type and the smallest norm. The name is the surface
    with most mentions, then the shortest, then the first seen.
    """
    classes = connected_components(matched.select(F.col("i").alias("u"), F.col("j").alias("v")))
    rows = records.join(classes.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("class", F.coalesce("component", "id"))
    best = F.max_by("surface", F.struct(F.col("n"), -F.length("surface"), -F.col("id")))
    grouped = rows.groupBy("class", "type").agg(
        F.min("norm").alias("low"), best.alias("name"), F.sort_array(F.collect_set("surface")).alias("every"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("mention_chunks"), F.sum("n").alias("mention_count")
    )
    return grouped.select(X.digest("type", "low").alias("canonical_id"), "type", "name", F.array_except("every", F.array("name")).alias("aliases"), "mention_chunks", "mention_count")


def largest(built: DataFrame, n: int = 8) -> DataFrame:
    """The entities with most aliases, ties by id."""
    return built.select("canonical_id", "name", F.size("aliases").alias("n_aliases")).orderBy(F.desc("n_aliases"), "canonical_id").limit(n)


def _unordered(rows: DataFrame, order: list) -> DataFrame:
    """The first of rows(a, b, …) for each unordered pair of norms, by order; equal and empty norms go."""
    rows = rows.withColumns({"na": X.normalize("a"), "nb": X.normalize("b")}).filter("na <> nb and na <> '' and nb <> ''")
    w = Window.partitionBy(F.array_sort(F.array("na", "nb"))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "na", "nb")


def declared_pairs(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """a, b: long and short names that a text declares, where both norms are among names(norm)."""
    found = chunks.select(F.explode(X.alias_pairs("text")).alias("p")).select(F.col("p.long").alias("a"), F.col("p.short").alias("b")).filter(X.declares("a", "b")).distinct()
    known = names.select("norm").distinct()
    return found.join(known, X.normalize(F.col("a")) == known["norm"], "left_semi").join(known, X.normalize(F.col("b")) == known["norm"], "left_semi")


def chunk_mentions(chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """chunks with the mentions that extractions(chunk_id, mentions) have of them; none is an empty array."""
    kind = extractions.schema["mentions"].dataType
    found = chunks.join(extractions.select("chunk_id", "mentions"), "chunk_id", "left")
    return found.withColumn("mentions", F.coalesce("mentions", F.array().cast(kind)))


def listed_pairs(exhibits: DataFrame) -> DataFrame:
    """a, b, source from exhibits(chunk_id, filer, names array): filer and each name, and all two names of one list, the earlier one first.

    Each is one row, however many lists have it. Of a list's repeated names one
    comes before another if its first place is before that one's last. Lists are
    cut into blocks of about LIST names that meet two by two, so that a long one
    is many tasks' work, and only pairs whose names both are in several lists are
    made distinct, as no other pair can come twice.
    """
    rows = exhibits.select("chunk_id", "filer", F.posexplode("names").alias("pos", "name"))
    rows = rows.groupBy("chunk_id", "filer", "name").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    rows = materialize(rows, "listed", light=True)
    parent = rows.filter("name <> filer").select(F.col("filer").alias("a"), F.col("name").alias("b"), F.lit("ex21-parent").alias("source")).distinct()
    several = rows.groupBy("name").agg((F.count("*") > 1).alias("several"))
    blocks = materialize(rows.groupBy("chunk_id").agg(F.ceil(F.count("*") / LIST).cast("int").alias("blocks")), "blocks", light=True)
    tiles = blocks.agg(F.coalesce(F.sum(F.col("blocks").cast("long") * F.col("blocks")), F.lit(0))).first()[0]
    tasks = max(1, min(MOST_TASKS, tiles // 4))  # said outright, as few names may give many pairs
    known = rows.join(several.withColumnRenamed("name", "known"), F.col("name").eqNullSafe(F.col("known"))).drop("known")
    dealt = materialize(known.join(blocks, "chunk_id").withColumn("own", F.pmod(F.xxhash64("name"), "blocks").cast("int")), "dealt", light=True)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    l = dealt.select("chunk_id", F.col("own").alias("row"), other.alias("column"), "low", F.col("name").alias("a"), F.col("several").alias("a_several"))
    r = dealt.select("chunk_id", other.alias("row"), F.col("own").alias("column"), "high", F.col("name").alias("b"), F.col("several").alias("b_several"))
    tile = ["chunk_id", "row", "column"]
    met = lambda l, r: l.repartition(tasks, *tile).join(r.repartition(tasks, *tile), tile).filter("low < high").select("a", "b", F.lit("ex21-sibling").alias("source"))
    both = met(l.filter("a_several"), r.filter("b_several")).distinct()
    return parent.unionByName(met(l.filter("not a_several"), r)).unionByName(met(l.filter("a_several"), r.filter("not b_several"))).unionByName(both)


def mine_pairs(hand: DataFrame, declared: DataFrame, listed: DataFrame, negatives: int = 220) -> DataFrame:
    """a, b, same, source: hand labels kept, declared ones regenerated, and an even stride of listed ones as negatives.

    listed has no row twice, as `listed_pairs` gives it. Its rows are counted by
    a, the counts ordered and summed up, and only those names' pairs are put in
    order among which a chosen place lies.
    """
    starts = numbered(listed.groupBy("a").agg(F.count("*").alias("n")), ["a"], "start", "n")
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = range(total) if total <= negatives else [int(i * total / negatives) for i in range(negatives)]
    held = starts.withColumn("places", F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n"))))
    held = materialize(held.filter(F.size("places") > 0).select(F.col("a").alias("first"), "start", "places"), "chosen", light=True)  # as many as negatives at most
    named = [r.first for r in held.select("first").collect()]
    few = listed.filter(F.col("a").isin([n for n in named if n is not None]) | (F.col("a").isNull() if None in named else F.lit(False)))
    order = F.row_number().over(Window.partitionBy("a").orderBy(F.col("b").asc_nulls_first(), "source")) - 1
    chosen = few.withColumn("place", order).join(F.broadcast(held), F.col("a").eqNullSafe(F.col("first"))).filter(F.array_contains("places", F.col("start") + F.col("place")))
    every = (
        hand.select("a", "b", "same", F.lit("hand").alias("source"), F.lit(0).alias("rank"))
        .unionByName(declared.select("a", "b", F.lit(True).alias("same"), F.lit("alias-declaration").alias("source"), F.lit(1).alias("rank")))
        .unionByName(chosen.select("a", "b", F.lit(False).alias("same"), "source", F.lit(2).alias("rank")))
    )
    return _unordered(every, ["rank", "a", "b"]).drop("rank")


def boundary_pairs(scored: DataFrame, tau: float = TAU, limit: int = 80) -> DataFrame:
    """The pairs of scored(a, b, similarity) nearest to the threshold, one for each unordered pair of norms; of equal ones the less similar."""
    return _unordered(scored.withColumn("gap", F.abs(F.col("similarity") - tau)), ["gap", "a", "b", "similarity"]).orderBy("gap", "a", "b").limit(limit)


def sweep(pairs: DataFrame, floor: float = FLOOR, thresholds: int = 14) -> DataFrame:
    """tau, tp, fp, fn, precision, recall, f1 over pairs(same, similarity, jaccard, fixed boolean) for thresholds 0.70, 0.72, …

    fixed: a rule other than the vectors' says match (null: none says anything).
    """
    taus = F.explode(F.transform(F.sequence(F.lit(0), F.lit(thresholds - 1)), lambda k: F.round(F.lit(0.70) + k * 0.02, 2))).alias("tau")
    rows = pairs.select("same", "similarity", "jaccard", "fixed", taus)
    hit = F.coalesce("fixed", (F.col("similarity") >= F.col("tau")) & (F.col("jaccard") >= floor))
    counts = rows.groupBy("tau").agg(F.count_if(hit & F.col("same")).alias("tp"), F.count_if(hit & ~F.col("same")).alias("fp"), F.count_if(~hit & F.col("same")).alias("fn"))
    return prf(counts)


def prf(counts: DataFrame) -> DataFrame:
    """counts(…, tp, fp, fn) with precision, recall and f1; 0 where nothing divides."""
    safe = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return counts.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")), "f1": safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
