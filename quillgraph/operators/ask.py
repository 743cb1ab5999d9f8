"""One question from plan to cited answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import context, graph, models, routing, vector
from quillgraph.schemas import RELATIONS, ontology


def ask(question: str, *, chat: models.Chat, embed: models.Embed, store: DataFrame, nodes: DataFrame, edges: DataFrame, index: DataFrame, prompts: dict, k: int = 10, relations=RELATIONS) -> dict:
    """route, ids, facts, counts, answer for a question.

    store(chunk_id, text, embedding) and the graph tables stay distributed; what
    comes to the driver is bounded by the caps on walks, facts and passages.
    Graph questions that find nothing fall back to vectors.
    """
    spark = store.sparkSession
    allowed = [r[0] for r in relations]
    plan, error = models.make_plan(question, chat, prompts["plan"], {})
    asked = spark.createDataFrame([(e,) for e in plan.entities], "surface string")
    found = [r.canonical_id for r in routing.resolve_names(asked, index).collect() if r.canonical_id]
    row = spark.createDataFrame([(plan.route, plan.confidence, plan.shape, plan.chain, found)], "route string, confidence string, shape string, chain array<string>, node_ids array<string>")
    decided = routing.decide(row).first()
    route, chain = decided.final_route, decided.final_chain
    if route == "refuse":
        return {"route": route, "answer": {"answerable": False, "refusal_reason": "router_refused", "claims": [], "attempts": 0}, "ids": [], "facts": [], "counts": []}
    anchors = spark.createDataFrame([(i,) for i in found], "id string")
    names = nodes.select("id", "name")
    facts, counts, graph_ids = [], [], []
    if route in ("graph", "both") and found:
        if chain:
            walks = graph.paths(edges, anchors, chain, allowed).orderBy(F.desc("total_support"), "anchor", "rank").limit(200).withColumn("path", F.col("rank") - 1)
            hops = F.array(*[F.struct(F.lit(n).alias("hop"), F.lit(p).alias("predicate"), (F.col("anchor") if n == 0 else F.col(f"node_{n}")).alias("s"), F.col(f"node_{n + 1}").alias("o")) for n, p in enumerate(chain)])
            hop = walks.select("path", F.explode(hops).alias("h")).select("path", "h.*")
            ends = edges.select(F.col("subject_id").alias("s"), "predicate", F.col("object_id").alias("o"), "chunk_ids", "support")
            steps = hop.join(ends, ["s", "predicate", "o"])
        else:
            touching = graph.neighbourhood(edges, anchors)
            ranked = touching.orderBy(F.desc("support"), "subject_id", "predicate", "object_id").limit(200)
            steps = ranked.withColumn("hop", F.lit(0)).withColumn("path", F.row_number().over(Window.orderBy(F.desc("support"), "subject_id", "predicate", "object_id")) - 1).withColumnsRenamed({"subject_id": "s", "object_id": "o"})
            tallies = graph.neighbourhood_counts(edges, anchors, nodes, cites=context.PER_FACT).join(names.select(F.col("id").alias("anchor"), F.col("name").alias("anchor_name")), "anchor")
            counts = [r.asDict() for r in context.verbalise_aggregates(tallies, ontology(spark, relations)).collect()]
        said = steps.join(names.select(F.col("id").alias("s"), F.col("name").alias("subject")), "s").join(names.select(F.col("id").alias("o"), F.col("name").alias("object")), "o")
        facts = [r.asDict() for r in context.verbalise(said.select("path", "hop", "subject", "predicate", "object", "chunk_ids", "support"), ontology(spark, relations), []).orderBy("path").collect()]
        graph_ids = list(dict.fromkeys(i for f in facts for i in f["chunk_ids"]))
    vector_ids = []
    if route in ("vector", "both") or not graph_ids:
        q = spark.createDataFrame([(-1, [float(x) for x in embed([question])[0]])], "id long, embedding array<float>")
        numbered = store.withColumn("id", F.xxhash64("chunk_id"))
        near = vector.topk(numbered, q, k, len(q.first().embedding))
        vector_ids = [r.chunk_id for r in near.join(numbered.select("id", "chunk_id"), "id").orderBy("rank").collect()]
    ids = list(dict.fromkeys(graph_ids + vector_ids))[:k]
    texts = [r.asDict() for r in graph.passages(ids, store.select("chunk_id", "text")).collect()]
    kinds = "facts array<struct<text: string, chunk_ids: array<string>>>, counts array<struct<text: string, chunk_ids: array<string>>>, passages array<struct<chunk_id: string, text: string>>"
    pick = lambda rows: [(r["text"], r["chunk_ids"]) for r in rows]
    frame = spark.createDataFrame([(pick(facts), pick(counts), [(t["chunk_id"], t["text"]) for t in texts])], kinds)
    text, valid = context.build_context(F.col("facts"), F.col("counts"), F.col("passages"))
    shown = frame.select(text.alias("text"), valid.alias("valid")).first()
    answer = models.synthesise(question, shown.text, set(shown.valid), chat, prompts["answer"], {})
    return {"route": route, "degraded": decided.degraded, "plan_error": error, "ids": ids, "facts": facts, "counts": counts, "answer": answer}
