"""Evaluation questions, mined from edges by templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import materialize, numbered
from quillgraph.schemas import closed


#: Edges of a relation whose names are looked up first, as a multiple of the questions wanted.
LEAD = 64


def one_hop(edges: DataFrame, names: DataFrame, templates: DataFrame, per_predicate: int = 2, order: list[Column] | None = None) -> DataFrame:
    """question, gold_chunk_ids, expected_answers, predicate, hops from edges and templates(predicate, template, side).

    A few edges of each relation, by ``order`` of edges' columns or a hash of their ends; both ends need names.
    side is the end that answers; null for none.

    Each relation's first edges meet the names, so that edges aren't shuffled;
    all edges do only if of some relation too few of the first have names.
    """
    s = names.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    o = names.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    w = Window.partitionBy("predicate").orderBy(*(order or [F.xxhash64("subject_id", "object_id")]), "subject_id", "object_id")
    asked = edges.join(F.broadcast(templates.select("predicate").distinct()), "predicate", "left_semi")
    lead = materialize(asked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= LEAD * per_predicate), "lead", light=True)
    named = materialize(F.broadcast(F.broadcast(lead).join(s, "subject_id")).join(o, "object_id"), "named", light=True)
    have = named.groupBy("predicate").agg(F.count_distinct("_n").alias("have"))
    short = lead.groupBy("predicate").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAD * per_predicate).join(have, "predicate", "left").filter(F.coalesce("have", F.lit(0)) < per_predicate)
    if not short.isEmpty():
        named = asked.join(s, "subject_id").join(o, "object_id")
    few = named.join(F.broadcast(templates), "predicate").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_predicate)
    text = F.replace(F.replace("template", F.lit("{subject}"), F.col("subject")), F.lit("{object}"), F.col("object"))
    expected = F.when(F.col("side") == "object", F.array("object")).when(F.col("side") == "subject", F.array("subject")).otherwise(F.array().cast("array<string>"))
    return few.select(text.alias("question"), F.col("chunk_ids").alias("gold_chunk_ids"), expected.alias("expected_answers"), "predicate", F.lit(1).cast("long").alias("hops"))


def chains(edges: DataFrame, chain: list[str], allowed, filing_of: DataFrame, want: int) -> DataFrame:
    """Walks along a chain with all nodes different and evidence from several filings, the first ``want`` by a hash."""
    walk = None
    for k, predicate in enumerate(chain):
        hop = edges.filter(F.col("predicate") == closed(predicate, allowed)).select(F.col("subject_id").alias(f"n{k}"), F.col("object_id").alias(f"n{k + 1}"), F.col("chunk_ids").alias(f"c{k}"))
        walk = hop if walk is None else walk.join(hop, f"n{k}")
    nodes = [f"n{k}" for k in range(len(chain) + 1)]
    ids = F.array_distinct(F.concat(*[F.slice(f"c{k}", 1, 1) for k in range(len(chain))]))
    walk = walk.filter(F.size(F.array_distinct(F.array(*nodes))) == len(nodes)).select(*nodes, ids.alias("gold_chunk_ids"))
    spread = walk.select(*nodes, F.explode("gold_chunk_ids").alias("chunk_id")).join(filing_of, "chunk_id").groupBy(*nodes).agg(F.size(F.collect_set("accession")).alias("filings")).filter("filings > 1")
    return walk.join(spread.drop("filings"), nodes, "left_semi").orderBy(F.xxhash64(*nodes), *nodes).limit(want)


def quota(chained: DataFrame, template: str, per_template: int, order: list) -> DataFrame:
    """The first ``per_template`` rows of each template, so that no chain crowds out the others."""
    w = Window.partitionBy(template).orderBy(*order)
    return chained.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_template).drop("_n")


def merged(mined: DataFrame) -> DataFrame:
    """One row a question text: gold and expected united, the rest from the first by ``ord``."""
    rest = [c for c in mined.columns if c not in ("question", "gold_chunk_ids", "expected_answers", "ord")]
    united = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return mined.groupBy("question").agg(united("gold_chunk_ids"), united("expected_answers"), *[F.min_by(c, "ord").alias(c) for c in rest])


def sample_strided(rows: DataFrame, order: list[str], want: int) -> DataFrame:
    """``want`` rows at an even stride of the given order, with their place."""
    ranked = numbered(rows, order)
    total = rows.count()
    return ranked if want >= total else ranked.filter(F.col("place").isin([int(i * total / want) for i in range(want)]))


def ids(rows: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """qid: a prefix and the row's number in three digits or more."""
    n = F.col("place").cast("string")
    return numbered(rows, order).withColumn("qid", F.concat(F.lit(prefix), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))).drop("place")


def known(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold ids that no chunk has."""
    return questions.select("qid", F.explode("gold_chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_anti")
