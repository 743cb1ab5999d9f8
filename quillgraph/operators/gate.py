"""One verdict over the stores: counts come from the passes that write what the checks join."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillgraph.operators.ann_index import Index
from quillgraph.runtime import materialize, shared_dir
from quillgraph.schemas import RELATIONS

#: The share of nodes without an edge that is let pass, passages that are looked up, and the entities that those have more than.
ORPHANS, LOOKED_UP, ENTITIES = 0.30, 20, 2


def _observed(df: DataFrame, measures: dict) -> tuple[DataFrame, Callable[[], dict]]:
    """df with an observation, and a function that gives its figures once df was written."""
    seen = Observation()
    named = [m.alias(name) for name, m in measures.items()]

    def figures() -> dict:
        try:
            return seen.get
        except Py4JError:  # the optimiser leaves nothing to observe of a table that it knows to be empty
            return df.agg(*named).first().asDict()

    return df.observe(seen, *named), figures


def verify(nodes: DataFrame, edges: DataFrame, passages: DataFrame, chunks: DataFrame, vectors: tuple[str, ...] = ("embedding",), indexes: dict[str, Index | None] | None = None, relations=RELATIONS, orphans: float = ORPHANS) -> tuple[dict, list[str]]:
    """(figures, failures) of nodes(id), edges(subject_id, predicate, object_id, chunk_ids), passages(chunk_id, entity_ids, vectors) and chunks(chunk_id).

    A failure names a breach: ``orphans``, nodes that no edge touches; ``loops``;
    ``empty relation`` of the vocabulary and ``unknown relation`` beside it; ``incomplete``, passages without a vector;
    ``parity``, passages and chunks that differ in number; ``join key``, where
    edges cite none of the first passages with several entities; ``index``, one
    that isn't there or of which cells are missing or changed.

    Every table is scanned once: figures are observed while the pass writes the
    ids that the joins need. Passages come first, so that of the evidence only
    the ids looked up are written.
    """
    spark, path = nodes.sparkSession, f"{shared_dir(nodes.sparkSession)}/gate-{uuid.uuid4().hex}"
    names = [r[0] for r in relations]
    per = {f"relation_{n}": F.count_if(F.col("predicate") == name) for n, name in enumerate(names)}
    known = {"edges": F.count(F.lit(1)), "loops": F.count_if(F.col("subject_id") == F.col("object_id")), "unknown": F.count_if(~F.col("predicate").isin(names))} | per
    seen_edges, of_edges = _observed(edges, known)
    text = lambda c: F.col(c).cast("string")
    whole = {"passages": F.count(F.lit(1))} | {f"lacking_{v}": F.count_if(F.col(v).isNull()) for v in vectors}
    seen_passages, of_passages = _observed(passages, whole)
    several = seen_passages.filter(F.size("entity_ids") > ENTITIES).select(text("chunk_id").alias("id")).orderBy("id").limit(LOOKED_UP)
    several = [r.id for r in materialize(several, "several", light=True).collect()]
    looked_up = len(several)

    mark = lambda kind, i: F.struct(F.lit(kind).alias("kind"), i.cast("string").alias("id"))
    cited = F.filter("chunk_ids", lambda i: i.cast("string").isin(several))
    marks = F.concat(F.array(mark("node", F.col("subject_id")), mark("node", F.col("object_id"))), F.transform(cited, lambda i: mark("chunk", i)))
    seen_edges.select(F.explode(marks).alias("m")).select("m.*").distinct().write.partitionBy("kind").parquet(path)
    touched = spark.read.schema("id string, kind string").parquet(path)

    seen_nodes, of_nodes = _observed(nodes, {"nodes": F.count(F.lit(1))})
    alone = seen_nodes.select(text("id").alias("id")).join(touched.filter("kind = 'node'").select("id"), "id", "left_anti").count()
    hits = {r.id for r in touched.filter("kind = 'chunk'").select("id").collect()}  # LOOKED_UP at most
    joined = sum(i in hits for i in several)

    e, n, p = of_edges(), of_nodes(), of_passages()
    figures = {"nodes": n["nodes"], "edges": e["edges"], "loops": e["loops"], "orphans": alone, "passages": p["passages"], "chunks": chunks.count(), "looked_up": looked_up, "joined": joined}
    figures |= {f"without {v}": p[f"lacking_{v}"] for v in vectors} | {f"edges of {name}": e[f"relation_{k}"] for k, name in enumerate(names)}
    failures = []
    if n["nodes"] and alone / n["nodes"] > orphans:
        failures.append(f"orphans: {alone} of {n['nodes']} nodes, more than {orphans:.0%}")
    if e["loops"]:
        failures.append(f"loops: {e['loops']}")
    failures += [f"empty relation: {name}" for k, name in enumerate(names) if not e[f"relation_{k}"]]
    if e["unknown"]:
        failures.append(f"unknown relation: {e['unknown']} edges")
    failures += [f"incomplete: {p[f'lacking_{v}']} passages without {v}" for v in vectors if p[f"lacking_{v}"]]
    if p["passages"] != figures["chunks"]:
        failures.append(f"parity: {p['passages']} passages, {figures['chunks']} chunks")
    if looked_up and not joined:
        failures.append(f"join key: no edge cites any of {looked_up} passages")
    for name, index in (indexes or {}).items():
        problems = ["it isn't there"] if index is None else [f"cell {r.cell} {r.problem}" for r in index.check().orderBy("part", "cell").limit(5).collect()]
        failures += [f"index {name}: {x}" for x in problems]
    return figures, failures
