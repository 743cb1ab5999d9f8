"""Plans and routes: what is asked of the graph, of the vectors, of both, or refused."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators.fulltext import Inverted
from quillgraph.runtime import shared_dir

ROUTES = ("graph", "vector", "both", "refuse")
#: Hops of each shape of question.
SHAPES = {"none": 0, "one_hop": 1, "two_hop": 2, "three_hop": 3}


@dataclass
class Plan:
    route: str
    confidence: str = "high"
    entities: list[str] = field(default_factory=list)
    shape: str = "none"
    chain: list[str] = field(default_factory=list)


def decide(plans: DataFrame) -> DataFrame:
    """plans(route, confidence, shape, chain, node_ids) with final_route, final_chain and degraded, the reasons joined by +.

    In order: a chain whose length isn't its shape's is dropped, and graph
    becomes both; without anchors graph and both become vector; a low
    confidence makes both of graph or vector, also of what just became vector.
    """
    length = F.lit(None).cast("int")
    for shape, n in SHAPES.items():
        length = F.when(F.col("shape") == shape, n).otherwise(length)
    wrong = ~F.size("chain").eqNullSafe(length)
    one = F.when(wrong & (F.col("route") == "graph"), "both").otherwise(F.col("route"))
    lost = one.isin("graph", "both") & (F.size("node_ids") == 0)
    two = F.when(lost, "vector").otherwise(one)
    unsure = (F.col("confidence") == "low") & two.isin("graph", "vector")
    reasons = F.concat_ws("+", F.when(wrong, "chain_shape_mismatch"), F.when(lost, "no_anchor"), F.when(unsure, "low_confidence"))
    return plans.withColumns({"final_route": F.when(unsure, "both").otherwise(two), "final_chain": F.when(wrong, F.array().cast("array<string>")).otherwise(F.col("chain")), "degraded": reasons})


def expected_routes(hops: Column, category: Column, source: Column) -> Column:
    """Routes that answer a question of so many hops."""
    return (
        F.when(hops == 0, F.array(F.lit("refuse")))
        .when(category.eqNullSafe(F.lit("aggregation")) | (hops >= 2), F.array(F.lit("both"), F.lit("graph")))
        .when(source == "hand", F.array(F.lit("both"), F.lit("vector")))
        .otherwise(F.array(F.lit("both"), F.lit("graph"), F.lit("vector")))
    )


def alias_index(entities: DataFrame) -> DataFrame:
    """norm, canonical_id, rank: all names and aliases; of one norm the entity with most mentions first."""
    names = entities.select("canonical_id", "mention_count", F.explode(F.array_union(F.array("name"), "aliases")).alias("surface"))
    norms = names.select("canonical_id", "mention_count", X.normalize("surface").alias("norm")).filter("norm <> ''").distinct()
    w = Window.partitionBy("norm").orderBy(F.desc("mention_count"), "canonical_id")
    return norms.withColumn("rank", F.row_number().over(w).cast("long")).select("norm", "canonical_id", "rank")


def name_texts(index: DataFrame) -> DataFrame:
    """id, words of each entity of an alias index: those of all its names, for `Inverted.build`."""
    words = F.flatten(F.transform(F.sort_array(F.collect_set("norm")), lambda n: F.filter(F.split(n, " "), lambda w: w != "")))  # an entity's own names
    return index.groupBy(F.col("canonical_id").alias("id")).agg(words.alias("words"))


def resolve_names(asked: DataFrame, index: DataFrame, names: Inverted | None = None) -> DataFrame:
    """asked(surface) with canonical_id: the first of an equal norm, else the best of a full-text search, else null.

    names is an inverted index of `name_texts`; one is made where none is given.
    The search scores by BM25; of equal scores the entity with fewer words
    wins, then the smaller id.
    """
    q = asked.select("surface").distinct().withColumn("norm", X.normalize("surface"))
    exact = q.join(index.filter("rank = 1").select("norm", F.col("canonical_id").alias("exact_id")), "norm", "left")
    missing = exact.filter("exact_id is null").select(F.col("surface").alias("q"), X.tokens(X.normalize(X.query_words("surface"))).alias("words"))
    names = names or Inverted.build(name_texts(index), f"{shared_dir(asked.sparkSession)}/names-{uuid.uuid4().hex}")
    best = names.best(missing).select(F.col("q").alias("surface"), F.col("id").alias("near_id"))
    return asked.join(exact.join(best, "surface", "left").select("surface", F.coalesce("exact_id", "near_id").alias("canonical_id")), "surface", "left")


def merge_ranked(graph_ids: Column | str, vector_ids: Column | str, k: int) -> Column:
    """Graph ids first, then vector ids, each once, k at most."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(graph_ids, empty), F.coalesce(vector_ids, empty))), 1, k)


def ids_of_steps(steps: DataFrame, by: list[str], k: int) -> DataFrame:
    """ids: evidence of steps(…by, path, hop, chunk_ids) in order of first appearance, k at most."""
    rows = steps.select(*by, "path", "hop", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    first = rows.groupBy(*by, "chunk_id").agg(F.min(F.struct("path", "hop", "pos")).alias("at"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"])
    return first.groupBy(*by).agg(F.slice(ordered, 1, k).alias("ids"))
