"""Queries over stores that outlive a session, streams, calls and the gate, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from quillgraph.operators import ann_index, chat, gate, strict
from quillgraph.operators.fulltext import Inverted
from quillgraph.plans import tpch_graph as G
from quillgraph.plans.registry import Registry, table
from quillgraph.runtime import shared_dir
from quillgraph.sources.feeds import EventLines
from quillgraph.streaming import merge, supersede

query = Registry()


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query()
def ann_index_recall(spark, sf_dir):
    """Recall of the index on disk against the exact search, and what a query reads of it."""
    corpus = _vectors(spark, sf_dir)
    index = ann_index.Index.build(corpus, _folder(spark, "index"), 64)
    return ann_index.report(index, corpus, corpus.filter("id % 20 = 0"), 10)


@query()
def ann_width_sweep(spark, sf_dir):
    """Recall and time a query of indexes over leading dimensions, by the number of cells probed."""
    corpus = _vectors(spark, sf_dir)
    indexes = {w: ann_index.Index.build(corpus, _folder(spark, f"index-{w}"), w) for w in (32, 64)}
    return ann_index.sweep(indexes, corpus, corpus.filter("id % 20 = 0"), 10, (4, None), 2)


@query("SELECT count(*) AS n, sum(vec_id)::BIGINT AS ids, 0::BIGINT AS problems FROM embeddings WHERE embedding IS NOT NULL")
def ann_index_catalogue(spark, sf_dir):
    """Rows and problems of an index that was built of some rows, took the others later, and is opened anew."""
    corpus, folder = _vectors(spark, sf_dir), _folder(spark, "index")
    index = ann_index.Index.build(corpus.filter("id % 3 > 0"), folder, 64)
    index.add(corpus.filter("id % 3 = 0"))
    index = ann_index.Index(spark, folder)
    found = index.check()
    rows = index.rows().select(F.lit(1).alias("n"), "id", F.lit(0).alias("problem")).unionByName(found.select(F.lit(0).alias("n"), F.lit(0).cast("long").alias("id"), F.lit(1).alias("problem")))
    return rows.agg(F.sum("n").alias("n"), F.sum("id").alias("ids"), F.sum("problem").alias("problems"))


@query("""WITH t AS (SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ') AS w FROM part), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
c AS (SELECT id, len(w) AS size, word, count(*) AS tf FROM (SELECT id, w, unnest(w) AS word FROM t) GROUP BY ALL), d AS (SELECT word, count(*) AS df FROM c GROUP BY word),
p AS (SELECT c.word, id, size, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a)), 9) AS weight FROM c JOIN d USING (word), n),
q AS (SELECT p_partkey AS q, unnest(list_distinct(string_split(lower(split_part(p_name, ' ', 2) || ' ' || p_type || ' unheard'), ' '))) AS word FROM part WHERE p_partkey % 20 = 0),
s AS (SELECT q, id, any_value(size) AS size, sum(weight::DECIMAL(28, 9))::DOUBLE AS score FROM q JOIN p USING (word) GROUP BY q, id)
SELECT q, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, size, id) = 1""")
def fulltext_best(spark, sf_dir):
    """The best part by BM25 for some words of every 20th."""
    part = table(spark, sf_dir, "part")
    index = Inverted.build(part.select(F.col("p_partkey").alias("id"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ").alias("words")), _folder(spark, "words"))
    words = F.split(F.lower(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), "p_type", F.lit("unheard"))), " ")
    return index.best(part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("q"), words.alias("words"))).select("q", "id", F.round("score", 6).alias("score"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND NOT (value < 5 OR props LIKE '%"k": 1%')""")
def superseded_stream(spark, sf_dir):
    """The latest rows of a log that streams in out of order, in several micro-batches."""
    root, keys = _folder(spark, "stream"), ["user_id", "event_type"]
    events = table(spark, sf_dir, "events")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", supersede.PROVIDER)
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stale = (F.col("value") < 5) | F.col("props").contains('"k": 1')
    changes = supersede.superseded(log, keys, ["ts", "event_id"], stale)
    add = lambda batch, n: batch.withColumn("number", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/{n}")
    changes.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return supersede.current(spark.read.parquet(f"{root}/out/*"), keys, "number", events.schema).select(*keys, "event_id", "value")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def bucketed_merge(spark, sf_dir):
    """Counts a user, merged batch by batch into a bucketed table; one batch comes twice."""
    held = merge.Bucketed(spark, _folder(spark, "users"), "user_id long, n long, last long", ["user_id"], 16)
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.lit(1).cast("long").alias("n"), F.col("event_id").alias("last"))
    total = lambda old, new: old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    for number in (0, 1, 1, 2):
        held.merge(events.filter(F.col("last") % 3 == number), total, number)
    return held.read()


@query("SELECT event_id, event_type FROM events")
def event_lines(spark, sf_dir):
    """Events read back from the lines of event-stream files, as a stream."""
    root = _folder(spark, "lines")
    said = F.concat(F.lit("data: "), F.to_json(F.struct("event_id", "event_type")))
    table(spark, sf_dir, "events").select(F.explode(F.array(F.lit(": keep-alive"), said)).alias("line")).write.text(f"{root}/in")
    spark.dataSource.register(EventLines)
    lines = spark.readStream.format("event_lines").option("folder", f"{root}/in").option("suffix", ".txt").option("most", 1 << 16).load()
    lines.writeStream.format("parquet").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    data = F.from_json(F.regexp_extract("line", "^data: (.*)$", 1), "event_id long, event_type string")
    return spark.read.parquet(f"{root}/out").filter(F.col("line").startswith("data: ")).select(data.alias("r")).select("r.*")


RELATION = {
    "type": "object",
    "required": ["subject", "predicate", "support"],
    "properties": {"subject": {"type": "string"}, "predicate": {"enum": ["SUPPLIES", "BOUGHT"]}, "support": {"type": "integer"}, "chunks": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}}}}},
}


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '$.note: not in the schema' WHEN 2 THEN '$.subject: missing' WHEN 3 THEN '$.predicate: not one of the values: SELLS' WHEN 4 THEN '$.support: not an integer'
    WHEN 5 THEN '$: not JSON' ELSE '$.chunks[].id: missing;$.chunks[].place: not in the schema' END AS problems, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey::BIGINT END AS support FROM orders""")
def strict_replies(spark, sf_dir):
    """Replies against a closed schema, one in seven of which holds."""
    k, n = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    whole = F.concat(F.lit('{"subject": "a", "predicate": "SUPPLIES", "support": '), n)
    raw = (
        F.when(k == 0, F.concat(whole, F.lit(', "chunks": [{"id": "1"}, {"id": "2"}]}')))
        .when(k == 1, F.concat(whole, F.lit(', "note": "x"}')))
        .when(k == 2, F.concat(F.lit('{"predicate": "BOUGHT", "support": '), n, F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"subject": "a", "predicate": "SELLS", "support": '), n, F.lit("}")))
        .when(k == 4, F.lit('{"subject": "a", "predicate": "BOUGHT", "support": "many"}'))
        .when(k == 5, F.lit("no JSON at all"))
        .otherwise(F.concat(whole, F.lit(', "chunks": [{"id": "1"}, {"place": 3}]}')))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("reply"))
    found = strict.checked(rows, "reply", RELATION, "subject string, predicate string, support long, chunks array<struct<id: string>>")
    return found.select("o_orderkey", F.array_join("problems", ";").alias("problems"), F.col("parsed.support").alias("support"))


@query("WITH " + G.FACTS_SQL + """, e AS (SELECT s, p, o FROM facts GROUP BY s, p, o), t AS (SELECT s AS id FROM e UNION SELECT o FROM e), x AS (SELECT count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM t))
SELECT 'nodes' AS name, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM e) UNION ALL SELECT 'orphans', (SELECT n FROM x) UNION ALL SELECT 'passages', (SELECT count(*) FROM part)
UNION ALL SELECT 'joined', least(20, (SELECT count(*) FROM part)) UNION ALL SELECT 'FAIL empty relation: REPLACED_BY', NULL
UNION ALL SELECT 'FAIL incomplete: ' || (SELECT count(*) FROM part WHERE p_partkey % 100 = 0) || ' passages without embedding', NULL""")
def gate_figures(spark, sf_dir):
    """Figures and failures of the gate over the graph and a store of passages, some of which lack a vector."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    ids = F.array(F.concat(F.lit("p:"), key), F.concat(F.lit("b:"), "p_brand"), F.lit("x"))
    passages = part.select(F.concat(F.lit("part-"), key).alias("chunk_id"), ids.alias("entity_ids"), F.when(F.col("p_partkey") % 100 > 0, F.array(F.lit(1.0))).alias("embedding"))
    figures, failures = gate.verify(G.nodes(spark, sf_dir), G.edges(spark, sf_dir), passages, passages, relations=G.RELATIONS, orphans=1.0)
    rows = [(k, figures[k]) for k in ("nodes", "edges", "orphans", "passages", "joined")] + [(f"FAIL {f}", None) for f in failures]
    return spark.createDataFrame(rows, "name string, n long")


def _answer(system: str, user: str, schema: dict) -> tuple[str, int, int]:
    return json.dumps({"said": user[::-1]}), len(user), 2


@query("SELECT o_orderkey, '{\"said\": \"' || reverse(o_orderpriority) || '\"}' AS reply, o_orderkey % 2 = 0 AS cached FROM orders")
def chat_replies(spark, sf_dir):
    """Replies to requests of which half were asked before: each priority is asked once, then cached."""
    spoken = chat.ChatTable(spark, _folder(spark, "calls"), _answer, "m", {}, per_minute=1e9)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("s").alias("system"), F.col("o_orderpriority").alias("user"))
    odd = spoken.replies(rows.filter("o_orderkey % 2 = 1"))
    odd.count()
    return odd.unionByName(spoken.replies(rows.filter("o_orderkey % 2 = 0"))).select("o_orderkey", "reply", "cached")
