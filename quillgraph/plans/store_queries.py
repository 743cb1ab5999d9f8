"""Store, log, report and source queries over the test tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions import vectors as V
from quillgraph.operators import chunking, context, evals, graph, logs, questions, reports, resolve
from quillgraph.plans import tpch_graph as G
from quillgraph.plans.registry import Registry, table
from quillgraph.plans.text_queries import NORM
from quillgraph.sources import sections

query = Registry()
WITH = "WITH " + G.FACTS_SQL


def _text(prefix: str, column):
    return F.concat(F.lit(prefix), column.cast("string"))


@query("""WITH o AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'old' AS type FROM supplier), n AS (SELECT 's' || s_suppkey AS id, upper(s_name) AS name, 'new' AS type FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'p' || p_partkey, p_name, 'new' FROM part WHERE p_partkey % 50 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""")
def node_upsert(spark, sf_dir):
    supplier, part, k = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"), F.col("s_suppkey")
    old = supplier.select(_text("s", k).alias("id"), F.col("s_name").alias("name"), F.lit("old").alias("type"))
    new = supplier.filter(k % 3 == 0).select(_text("s", k).alias("id"), F.upper("s_name").alias("name"), F.lit("new").alias("type"))
    new = new.union(part.filter("p_partkey % 50 = 0").select(_text("p", F.col("p_partkey")), "p_name", F.lit("new")))
    return graph.merge_nodes(old, new)


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, 'd' || (item_id * 37 % 300) AS chunk_id, length(d.text) AS n_chars FROM benchmark LEFT JOIN documents d ON doc_id = item_id * 37 % 300 QUALIFY d.doc_id IS NOT NULL")
def ordered_lookup(spark, sf_dir):
    """Passages in the order of a list of ids, some of which no passage has."""
    pairs = table(spark, sf_dir, "benchmark").select("item_id", _text("d", F.col("item_id") * 37 % 300).alias("id"))
    wanted = pairs.agg(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "id"))), lambda x: x["id"]).alias("ids"))
    chunks = table(spark, sf_dir, "documents").select(_text("d", F.col("doc_id")).alias("chunk_id"), "text")
    return graph.passages(wanted, chunks).select(F.col("pos").cast("long").alias("pos"), "chunk_id", F.length("text").cast("long").alias("n_chars"))


RESOLVED = """WITH a AS (SELECT s_name AS surface, 'Company' AS type, 's' || s_suppkey AS id, s_suppkey AS ord FROM supplier UNION ALL SELECT p_name, 'Product', 'p' || p_partkey, p_partkey FROM part),
last AS (SELECT surface, type, arg_max(id, ord) AS id FROM a GROUP BY surface, type),
r AS (SELECT s_name AS subject, CASE WHEN l_linenumber = 7 THEN 'Person' ELSE 'Company' END AS st, CASE WHEN l_linenumber = 1 THEN s_name ELSE p_name END AS object, CASE WHEN l_linenumber = 1 THEN 'Company' ELSE 'Product' END AS ot
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
x AS (SELECT s.id AS subject_id, o.id AS object_id FROM r LEFT JOIN last s ON s.surface = subject AND s.type = st LEFT JOIN last o ON o.surface = object AND o.type = ot)
"""


def _resolved(spark, sf_dir):
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    aliases = supplier.select(F.col("s_name").alias("surface"), F.lit("Company").alias("type"), _text("s", F.col("s_suppkey")).alias("id"), F.col("s_suppkey").alias("ord"))
    aliases = aliases.union(part.select("p_name", F.lit("Product"), _text("p", F.col("p_partkey")), "p_partkey"))
    lines = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    relations = lines.select(
        F.col("s_name").alias("subject"), F.when(n == 7, "Person").otherwise("Company").alias("subject_type"), F.lit("R").alias("predicate"),
        F.when(n == 1, F.col("s_name")).otherwise(F.col("p_name")).alias("object"), F.when(n == 1, "Company").otherwise("Product").alias("object_type"),
    )
    return graph.resolve_endpoints(relations, aliases)


@query(RESOLVED + "SELECT subject_id, object_id, count(*) AS n FROM x GROUP BY ALL")
def endpoint_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("subject_id", "object_id").agg(F.count("*").alias("n"))


@query(RESOLVED + "SELECT CASE WHEN subject_id IS NULL OR object_id IS NULL THEN 'unresolved_endpoint' ELSE 'self_loop_after_resolution' END AS reason, count(*) AS n FROM x WHERE subject_id IS NULL OR object_id IS NULL OR subject_id = object_id GROUP BY 1")
def discarded_relations(spark, sf_dir):
    return graph.discarded(_resolved(spark, sf_dir))


STORE = """WITH m AS (SELECT DISTINCT 's' || s_suppkey AS id, 'd' || unnest([s_suppkey % 40, s_suppkey * 3 % 40, s_suppkey * 7 % 40]) AS chunk_id FROM supplier),
store AS (SELECT 'd' || doc_id AS chunk_id, list_sort(list(id) FILTER (id IS NOT NULL)) AS ids FROM documents LEFT JOIN m ON m.chunk_id = 'd' || doc_id GROUP BY doc_id)
"""


def _store(spark, sf_dir):
    k = F.col("s_suppkey")
    spots = F.array(_text("d", k % 40), _text("d", k * 3 % 40), _text("d", k * 7 % 40))
    entities = table(spark, sf_dir, "supplier").select(_text("s", k).alias("canonical_id"), spots.alias("mention_chunks"))
    return graph.store_rows(table(spark, sf_dir, "documents").select(_text("d", F.col("doc_id")).alias("chunk_id")), entities)


@query(STORE + "SELECT chunk_id, coalesce(array_to_string(ids, ','), '') AS entity_ids FROM store")
def store_rows(spark, sf_dir):
    return _store(spark, sf_dir).select("chunk_id", F.array_join("entity_ids", ",").alias("entity_ids"))


@query(STORE + ", c AS (SELECT chunk_id FROM store WHERE len(ids) > 2 ORDER BY chunk_id LIMIT 20) SELECT count(*) AS sampled, count(*) FILTER (chunk_id IN (SELECT 'd' || l_orderkey % 90 FROM lineitem WHERE l_linenumber = 3)) AS joined FROM c")
def join_key_check(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").filter("l_linenumber = 3").select(F.array(_text("d", F.col("l_orderkey") % 90)).alias("chunk_ids"))
    return graph.join_key_check(_store(spark, sf_dir), cited)


EXTRACTED = "SELECT l_orderkey AS row_ord, 'k' || l_orderkey % 50 AS chunk_id, p_name AS surface, CASE WHEN l_linenumber % 2 = 0 THEN 'Product' ELSE 'Company' END AS type FROM lineitem JOIN part ON p_partkey = l_partkey"


def _extractions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "Product").otherwise("Company")
    return lines.select(F.col("l_orderkey").alias("row_ord"), _text("k", F.col("l_orderkey") % 50).alias("chunk_id"), F.array(F.struct(F.col("p_name").alias("name"), kind.alias("type"))).alias("mentions"))


@query(f"WITH x AS ({EXTRACTED}) SELECT surface, type, {NORM.format(x='surface')} AS norm, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks, min(row_ord) AS first_row FROM x GROUP BY surface, type")
def mention_rollup(spark, sf_dir):
    found = resolve.mentions(_extractions(spark, sf_dir))
    return found.select("surface", "type", "norm", "n", F.size("chunks").cast("long").alias("n_chunks"), F.col("ord.row_ord").alias("first_row"))


@query(f"WITH x AS ({EXTRACTED} WHERE l_linenumber = 2) SELECT 'k' || i AS chunk_id, count(surface) AS n FROM range(0, 60) t(i) LEFT JOIN x ON x.chunk_id = 'k' || i GROUP BY i")
def chunk_mentions(spark, sf_dir):
    """Passages with their mentions, none for some."""
    found = _extractions(spark, sf_dir).withColumn("kind", F.col("mentions")[0]["type"])
    second = table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    mentions = second.select(_text("k", F.col("l_orderkey") % 50).alias("chunk_id"), F.struct(F.col("p_name").alias("name"), F.lit("Product").alias("type")).alias("m"))
    extractions = mentions.groupBy("chunk_id").agg(F.collect_list("m").alias("mentions"))
    chunks = found.sparkSession.range(60).select(_text("k", F.col("id")).alias("chunk_id"))
    return resolve.chunk_mentions(chunks, extractions).select("chunk_id", F.size("mentions").cast("long").alias("n"))


SCORED = """WITH s AS (SELECT 'q' || event_id AS qid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 END AS key, CASE WHEN event_id % 3 = 0 THEN 'correct' WHEN event_id % 3 = 1 THEN 'partial' ELSE 'refused' END AS verdict, 'asked ' || event_type AS question, 'because ' || repeat('x', (event_id % 100)::INT) AS reason FROM events) """


def _scored(spark, sf_dir):
    i = F.col("event_id")
    verdict = F.when(i % 3 == 0, "correct").when(i % 3 == 1, "partial").otherwise("refused")
    reason = F.concat(F.lit("because "), F.repeat(F.lit("x"), (i % 100).cast("int")))
    return table(spark, sf_dir, "events").select(_text("q", i).alias("qid"), F.when(i % 5 != 0, i % 2).alias("key"), verdict.alias("verdict"), F.concat(F.lit("asked "), "event_type").alias("question"), reason.alias("reason"))


@query(SCORED + "SELECT count(*) AS keyed, count(*) FILTER ((key = 1) = (verdict = 'correct')) AS agree, count(*) FILTER (key = 0 AND verdict = 'correct') AS n_rescued, count(*) FILTER (key = 1 AND verdict <> 'correct') AS n_overridden, min(qid) FILTER (key = 0 AND verdict = 'correct') AS first_rescued FROM s WHERE key IS NOT NULL")
def judge_key_agreement(spark, sf_dir):
    one = reports.agreement(_scored(spark, sf_dir))
    return one.select("keyed", "agree", F.size("rescued").cast("long").alias("n_rescued"), F.size("overridden").cast("long").alias("n_overridden"), F.array_min("rescued").alias("first_rescued"))


@query(SCORED + "SELECT qid, verdict, question, substr(reason, 1, 80) AS reason FROM s WHERE verdict <> 'correct'")
def miss_listing(spark, sf_dir):
    return reports.misses(_scored(spark, sf_dir))


ANSWERS = """WITH a AS (SELECT event_id, event_id % 4 <> 0 AS answerable, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 / 1000.0::DOUBLE END AS usd, value AS latency_ms, event_id % 11 = 0 AS fallback FROM events) """


def _answers(spark, sf_dir):
    i = F.col("event_id")
    usd = F.when(i % 3 == 0, 0.0).otherwise(i % 7 / 1000.0)
    return table(spark, sf_dir, "events").select(i, (i % 4 != 0).alias("answerable"), usd.alias("usd"), F.col("value").alias("latency_ms"), (i % 11 == 0).alias("fallback"))


@query(ANSWERS + "SELECT count(*) FILTER (usd > 0) AS billed, count(*) FILTER (usd <= 0 AND NOT answerable) AS free_refusals, count(*) FILTER (usd <= 0 AND answerable) AS cached, round(median(latency_ms) FILTER (usd > 0), 6) AS median_ms, round(avg(usd) FILTER (usd > 0), 6) AS mean_usd FROM a")
def billed_only(spark, sf_dir):
    return reports.billed(_answers(spark, sf_dir)).withColumn("median_ms", F.round("median_ms", 6))


@query(ANSWERS + ", s AS (SELECT unnest(['all', CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS stratum, answerable, fallback FROM a) SELECT stratum, count(*) FILTER (NOT answerable) AS refused, count(*) FILTER (fallback) AS fallbacks FROM s GROUP BY stratum")
def refusals_by_stratum(spark, sf_dir):
    strata = F.array(F.lit("all"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    return reports.refusals(_answers(spark, sf_dir).withColumn("strata", strata))


CLAIMED = """WITH a AS (SELECT conv_id, max(turn) > 1 AS answerable, count(*) AS claims, sum(turn % 3)::BIGINT AS citations, count(*) FILTER (turn % 3 = 0) AS uncited, conv_id % 5 AS n FROM conversations GROUP BY conv_id) """


@query(CLAIMED + "SELECT count(*) FILTER (answerable) AS answered, sum(claims)::BIGINT AS claims, sum(citations)::BIGINT AS citations, sum(uncited)::BIGINT AS uncited, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END)::BIGINT AS invented, count(*) FILTER (n > 1) AS repaired, count(*) FILTER (n = 0) AS reformatted FROM a")
def citation_integrity(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: _text("t", k))
    claim = F.struct("text", F.slice(ids, 1, (F.col("turn") % 3).cast("int")).alias("citations"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(claim).alias("claims"), (F.max("turn") > 1).alias("answerable"))
    n = F.col("conv_id") % 5
    answers = grouped.select("answerable", "claims", F.flatten(F.transform("claims", lambda c: c["citations"])).alias("cited"), F.when(n == 2, F.array(F.lit("t9"))).otherwise(F.array().cast("array<string>")).alias("invented"), n.alias("attempts"), (n == 0).alias("reformatted"))
    return evals.citation_report(answers)


@query("""WITH a AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'aggregation' END AS category, count(*) FILTER (turn % 2 = 0) + CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS expected, count(*) FILTER (turn % 2 = 0) AS n FROM conversations GROUP BY conv_id)
SELECT count(*) AS asked, count(*) FILTER (n = expected) AS exact, count(*) FILTER (n <> expected) AS n_missed, min('q' || conv_id) FILTER (n <> expected) AS first_missed FROM a WHERE category IS NOT NULL""")
def exact_count_report(spark, sf_dir):
    """Answers that state how many even turns a conversation has, some of them against a wrong key."""
    even = F.count_if(F.col("turn") % 2 == 0)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(even.alias("n")).select(
        _text("q", F.col("conv_id")).alias("qid"), F.when(F.col("conv_id") % 2 == 0, "aggregation").alias("category"), (F.col("n") + (F.col("conv_id") % 6 == 0).cast("int")).alias("expected_count"),
        F.array(F.struct(F.concat(F.lit("It has "), F.col("n").cast("string"), F.lit(" turns")).alias("text")), F.struct(F.lit("no more.").alias("text"))).alias("claims"),
    )
    return evals.exact_counts(rows).select("asked", "exact", F.size("missed").cast("long").alias("n_missed"), F.array_min("missed").alias("first_missed"))


@query("SELECT round(sum(length(text) // 4) * 0.02 / 1e6, 9) AS embedding_usd, round(0.5 / 20 * count(*), 6) AS remaining_usd FROM documents")
def cost_projection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spark.createDataFrame([(round(reports.embedding_usd(docs, "text", 0.02), 9), round(reports.projected_usd(0.5, 20, docs.count()), 6))], "embedding_usd double, remaining_usd double")


PAIRS = f"""WITH p AS (SELECT p_partkey, p_name AS a, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' Inc.' ELSE ' w' || p_partkey % 9 END AS b, (p_partkey * 37 % 100) / 100.0::DOUBLE AS similarity FROM part),
n AS (SELECT *, abs(similarity - 0.88) AS gap, {NORM.format(x="a")} AS na, {NORM.format(x="b")} AS nb FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY least(na, nb), greatest(na, nb) ORDER BY gap, a, b) AS k FROM n WHERE na <> nb AND na <> '' AND nb <> '')
SELECT a, b, similarity, round(gap, 6) AS gap FROM f WHERE k = 1 ORDER BY f.gap, a, b LIMIT 80"""


@query(PAIRS)
def boundary_pairs(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    other = F.concat(name, F.when(k % 4 == 0, " Inc.").otherwise(_text(" w", k % 9)))
    scored = table(spark, sf_dir, "part").select(name.alias("a"), other.alias("b"), (k * 37 % 100 / 100.0).alias("similarity"))
    return resolve.boundary_pairs(scored).withColumn("gap", F.round("gap", 6))


@query("SELECT 'e' || s_suppkey AS canonical_id, s_name AS name, s_suppkey % 6 AS n_aliases FROM supplier ORDER BY n_aliases DESC, canonical_id LIMIT 8")
def largest_entities(spark, sf_dir):
    k = F.col("s_suppkey")
    built = table(spark, sf_dir, "supplier").select(_text("e", k).alias("canonical_id"), F.col("s_name").alias("name"), F.slice(F.array(*[F.lit(str(x)) for x in range(6)]), 1, (k % 6).cast("int")).alias("aliases"))
    return resolve.largest(built).withColumn("n_aliases", F.col("n_aliases").cast("long"))


LISTED = """s AS (SELECT s_nationkey, n_name, s_name, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
listed AS (SELECT DISTINCT n_name AS a, s_name AS b, 'ex21-parent' AS source FROM s UNION SELECT x.s_name, y.s_name, 'ex21-sibling' FROM s x JOIN s y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)"""


def _listed(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lists = s.groupBy("n_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("names"))
    return resolve.listed_pairs(lists.select(F.col("n_name").alias("chunk_id"), F.col("n_name").alias("filer"), "names"))


@query(f"WITH {LISTED} SELECT * FROM listed")
def listed_pairs(spark, sf_dir):
    return _listed(spark, sf_dir)


@query(f"""WITH {LISTED}, h AS (SELECT s_name AS a, n_name AS b, s_suppkey % 2 = 0 AS same FROM s WHERE s_suppkey % 10 = 0), d AS (SELECT p_name AS a, p_name || ' w' || p_partkey AS b FROM part WHERE p_partkey % 40 = 0),
o AS (SELECT *, row_number() OVER (ORDER BY a, b, source) - 1 AS place, count(*) OVER () AS total FROM listed), c AS (SELECT * FROM o WHERE total <= 50 OR place IN (SELECT floor(i * t / 50.0)::BIGINT FROM range(0, 50) x(i), (SELECT count(*) AS t FROM listed))),
every AS (SELECT a, b, same, 'hand' AS source, 0 AS rank FROM h UNION ALL SELECT a, b, true, 'alias-declaration', 1 FROM d UNION ALL SELECT a, b, false, source, 2 FROM c),
n AS (SELECT *, {NORM.format(x="a")} AS na, {NORM.format(x="b")} AS nb FROM every), f AS (SELECT *, row_number() OVER (PARTITION BY least(na, nb), greatest(na, nb) ORDER BY rank, a, b) AS k FROM n WHERE na <> nb AND na <> '' AND nb <> '')
SELECT a, b, same, source FROM f WHERE k = 1""")
def mined_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    hand = s.filter("s_suppkey % 10 = 0").select(F.col("s_name").alias("a"), F.col("n_name").alias("b"), (F.col("s_suppkey") % 2 == 0).alias("same"))
    declared = table(spark, sf_dir, "part").filter("p_partkey % 40 = 0").select(F.col("p_name").alias("a"), F.concat("p_name", _text(" w", F.col("p_partkey"))).alias("b"))
    return resolve.mine_pairs(hand, declared, _listed(spark, sf_dir), 50)


@query("""WITH p AS (SELECT p_partkey AS k, 'Acme N' || p_partkey || ' Works' AS a, ['Works', 'Acme', 'Other', 'Anw'][(p_partkey % 4 + 1)::INT] AS b FROM part) SELECT a, b FROM p WHERE b <> 'Other' AND k % 3 <> 0""")
def declared_aliases(spark, sf_dir):
    """Names with a short form behind them, in quotes or not; some long forms are unknown, one short form belongs to none."""
    k = F.col("p_partkey")
    long, short = F.concat(_text("Acme N", k), F.lit(" Works")), F.get(F.array(*[F.lit(x) for x in ("Works", "Acme", "Other", "Anw")]), (k % 4).cast("int"))
    quote = F.when(k % 5 < 2, '"').otherwise("")
    chunks = table(spark, sf_dir, "part").select(F.concat(F.lit("we buy from "), long, F.lit(" ( "), quote, short, quote, F.lit(") a lot")).alias("text"))
    names = table(spark, sf_dir, "part").filter(k % 3 != 0).select(X.normalize(long).alias("norm")).union(spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("works", "acme", "other", "anw")]))))
    return resolve.declared_pairs(chunks, names)


@query("""WITH q AS (SELECT item_id, [item_id * 3 % 150, item_id * 7 % 150, item_id * 11 % 150] AS gold, CASE WHEN item_id % 3 = 0 THEN item_id END AS n, CASE WHEN item_id % 4 = 0 THEN 'one; two' END AS known FROM benchmark),
g AS (SELECT item_id, i, 'd' || gold[i] AS chunk_id FROM q, (SELECT unnest([1, 2, 3]) AS i)), s AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY chunk_id) AS pos, chunk_id FROM g),
t AS (SELECT s.*, text, sum(length(text)) OVER (PARTITION BY item_id ORDER BY pos) AS running FROM s JOIN documents ON 'd' || doc_id = chunk_id WHERE text IS NOT NULL),
b AS (SELECT item_id, string_agg('[' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS passages, count(*) AS shown FROM t WHERE running <= 6000 GROUP BY item_id)
SELECT 'q' || item_id AS qid, md5(concat_ws(chr(10) || chr(10), CASE WHEN n IS NOT NULL THEN 'Exact count: ' || n END, CASE WHEN known IS NOT NULL THEN 'Known answers: ' || known END, passages, CASE WHEN coalesce(shown, 0) < 3 THEN 'Passages left out: ' || (3 - coalesce(shown, 0)) END)) AS digest FROM q LEFT JOIN b USING (item_id)""")
def judge_evidence(spark, sf_dir):
    i = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(
        _text("q", i).alias("qid"), F.array(*[_text("d", i * k % 150) for k in (3, 7, 11)]).alias("gold_chunk_ids"), F.when(i % 3 == 0, i).alias("expected_count"),
        F.when(i % 4 == 0, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>")).alias("expected_answers"),
    )
    passages = table(spark, sf_dir, "documents").select(_text("d", F.col("doc_id")).alias("chunk_id"), "text")
    return reports.evidence(asked, passages, chars=6000).select("qid", F.md5("reference").alias("digest"))


FACT = "'- ' || s_name || ' has fact {k} [e{k}1, e{k}2, e{k}3]'"


@query(f"""SELECT s_suppkey, md5(concat_ws(chr(10) || chr(10), CASE WHEN s_suppkey % 4 <> 0 THEN 'Counts' || chr(10) || '- ' || s_name || ' has 7 [c1, c2]' END,
    CASE WHEN s_suppkey % 3 = 1 THEN 'Facts' || chr(10) || {FACT.format(k=1)} WHEN s_suppkey % 3 = 2 THEN 'Facts' || chr(10) || {FACT.format(k=1)} || chr(10) || {FACT.format(k=2)} END,
    'Passages' || chr(10) || array_to_string(list_transform(range(0, least(10, 1 + s_suppkey % 13)), lambda i: '[p' || i || ']' || chr(10) || 'text ' || i), chr(10)))) AS digest,
    (CASE WHEN s_suppkey % 4 <> 0 THEN 2 ELSE 0 END + 3 * (s_suppkey % 3) + least(10, 1 + s_suppkey % 13))::BIGINT AS n_citable FROM supplier""")
def context_block(spark, sf_dir):
    k = F.col("s_suppkey")

    def rows(n, make):
        return F.slice(F.array(*[make(x) for x in range(n[1])]), 1, n[0].cast("int"))

    fact = lambda x: F.struct(F.concat("s_name", F.lit(f" has fact {x + 1}")).alias("text"), F.array(*[F.lit(f"e{x + 1}{y}") for y in range(1, 6)]).alias("chunk_ids"))
    total = lambda x: F.struct(F.concat("s_name", F.lit(" has 7")).alias("text"), F.array(F.lit("c1"), F.lit("c2")).alias("chunk_ids"))
    passage = lambda x: F.struct(F.lit(f"p{x}").alias("chunk_id"), F.lit(f"text {x}").alias("text"))
    text, shown = context.build_context(rows((k % 3, 2), fact), rows(((k % 4 != 0).cast("int"), 1), total), rows((1 + k % 13, 13), passage))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.md5(text).alias("digest"), F.size(shown).cast("long").alias("n_citable"))


@query("""WITH k AS (SELECT event_id, event_id % 4 AS hops, event_id % 9 = 0 AS counted, event_id % 7 = 0 AS refused, event_id % 8 = 0 AS keyless, event_id % 5 AS said FROM events)
SELECT event_id, CASE WHEN hops = 0 THEN refused::INT WHEN counted THEN (NOT refused AND said = 3)::INT WHEN keyless THEN NULL ELSE (NOT refused AND said IN (1, 3))::INT END::DOUBLE AS score FROM k""")
def key_scores(spark, sf_dir):
    """Answers scored by keys: refusals, a stated count, a name that occurs; some questions have no key."""
    i = F.col("event_id")
    said = F.get(F.array(*[F.lit(x) for x in ("Nothing.", "Blue River, Inc. leads.", "Bluer Rivers", "There are three at blue river", "2 of them")]), (i % 5).cast("int"))
    expected = F.when(i % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Blue River Corp")))
    score = evals.key_score(i % 4, F.when(i % 9 == 0, "aggregation"), i % 7 == 0, expected, F.lit(3).cast("long"), said)
    return table(spark, sf_dir, "events").select("event_id", score.cast("double").alias("score"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '[-+&|!(){}\[\]^"~*?:\\/]', ' ', 'g') AS words FROM conversations""")
def search_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.query_words("text").alias("words"))


FILINGS = """f AS (SELECT 'T' || o_custkey % 40 AS ticker, ['10-K', 'DEF 14A', '8-K', 'S-1'][(o_orderkey % 4 + 1)::INT] AS form, 'a' || o_orderkey AS accession, o_orderdate::DATE AS filing_date, o_orderkey FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY filing_date DESC, accession DESC) AS k FROM f WHERE form <> 'S-1'), newest AS (SELECT * FROM n WHERE k <= CASE form WHEN '8-K' THEN 8 ELSE 1 END)"""


def _newest(spark, sf_dir):
    k = F.col("o_orderkey")
    form = F.get(F.array(*[F.lit(x) for x in ("10-K", "DEF 14A", "8-K", "S-1")]), (k % 4).cast("int"))
    body = F.concat(F.lit("Sales  grew\t"), F.repeat(F.lit("more and "), (k % 50).cast("int")))
    parts = F.create_map(F.lit("Item 1"), body, F.lit("Item 5.02"), F.concat(body, F.lit("here.")), F.lit("Item 9"), body)
    exhibits = F.array(F.struct(F.lit("EX-10").alias("kind"), body.alias("text")), F.struct(F.lit("EX-21.1").alias("kind"), F.concat(body, F.lit("list")).alias("text")))
    orders = table(spark, sf_dir, "orders").select(_text("T", F.col("o_custkey") % 40).alias("ticker"), F.lit("C").alias("company"), F.lit(1).cast("long").alias("cik"), form.alias("form"), _text("a", k).alias("accession"), X.as_date(F.col("o_orderdate").cast("string")).alias("filing_date"), parts.alias("sections"), exhibits.alias("exhibits"))
    return sections.newest(orders)


@query(f"WITH {FILINGS} SELECT ticker, form, accession, strftime(filing_date, '%Y-%m-%d') AS filed FROM newest")
def newest_filings(spark, sf_dir):
    return _newest(spark, sf_dir).select("ticker", "form", "accession", F.col("filing_date").cast("string").alias("filed"))


@query(f"""WITH {FILINGS}, m AS (SELECT ticker, min(accession) AS sole FROM newest WHERE ticker < 'T2' GROUP BY ticker)
SELECT n.ticker, accession FROM newest n LEFT JOIN m ON m.ticker = n.ticker WHERE sole IS NULL OR sole = accession""")
def pinned_filings(spark, sf_dir):
    found = _newest(spark, sf_dir)
    manifest = found.filter("ticker < 'T2'").groupBy("ticker").agg(F.array(F.min("accession")).alias("accessions"))
    return sections.pinned(found, manifest).select("ticker", "accession")


@query(f"""WITH {FILINGS}, b AS (SELECT *, 'Sales grew ' || repeat('more and ', (o_orderkey % 50)::INT) AS body FROM newest),
d AS (SELECT accession, CASE form WHEN 'DEF 14A' THEN form ELSE form || '/' || item END AS section_path, form, item, CASE item WHEN 'Item 5.02' THEN body || 'here.' WHEN 'EX-21' THEN body || 'list' ELSE body END AS body FROM b, (SELECT unnest(['Item 1', 'Item 5.02', 'Item 9', 'EX-21']) AS item)
    WHERE (form = '10-K' AND item IN ('Item 1', 'EX-21')) OR (form = '8-K' AND item = 'Item 5.02') OR (form = 'DEF 14A' AND item <> 'EX-21'))
SELECT accession, section_path, length(trim(body)) AS n_chars FROM d WHERE length(trim(body)) >= 200""")
def section_documents(spark, sf_dir):
    return sections.flatten(_newest(spark, sf_dir)).select("accession", "section_path", F.length("text").cast("long").alias("n_chars"))


@query("SELECT 'q' || item_id AS qid, 'd' || (item_id * 97 % 3000) AS chunk_id FROM benchmark WHERE item_id * 97 % 3000 NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def unknown_gold(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(_text("q", F.col("item_id")).alias("qid"), F.array(_text("d", F.col("item_id") * 97 % 3000)).alias("gold_chunk_ids"))
    return questions.known(asked, table(spark, sf_dir, "documents").select(_text("d", F.col("doc_id")).alias("chunk_id")))


@query("SELECT l_orderkey || '-' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicated_keys(spark, sf_dir):
    return chunking.duplicated(table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")), "key")


@query("SELECT split_part(p_type, ' ', 1) AS kind, count(*) AS n FROM part GROUP BY 1")
def counts_by_kind(spark, sf_dir):
    return reports.by_kind(table(spark, sf_dir, "part"), F.split_part("p_type", F.lit(" "), F.lit(1)))


@query("SELECT a.vec_id, round(CASE WHEN a.vec_id % 50 = 0 THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def guarded_cosine(spark, sf_dir):
    """Neighbours' cosine, with some vectors of zeros."""
    e = table(spark, sf_dir, "embeddings")
    zero = F.transform("embedding", lambda x: x * 0)
    a = e.select("vec_id", F.when(F.col("vec_id") % 50 == 0, zero).otherwise(F.col("embedding")).alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine("a", "b", 1e-9), 6).alias("similarity"))


@query("SELECT event_id, length(regexp_replace(props, '[^0-9]', '', 'g')) / greatest(length(regexp_replace(props, '\\s', '', 'g')), 1)::DOUBLE AS density FROM events")
def digit_density(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.digit_density("props").alias("density"))


@query("SELECT s_suppkey, 'Is ' || s_name || ' in ' || n_name || '?' AS question FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def filled_templates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", X.fill("Is {name} in {place}?", name=F.col("s_name"), place=F.col("n_name")).alias("question"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stamped_events(spark, sf_dir):
    at = X.iso_utc("ts")
    return table(spark, sf_dir, "events").select("event_id", at.alias("at"), X.as_date(at).cast("string").alias("day"))


@query(WITH + """, w AS (SELECT a.s AS n0, a.o AS n1, b.o AS n2, a.lo AS c0, b.lo AS c1 FROM edges a JOIN edges b ON b.s = a.o AND b.p = 'PART_OF' WHERE a.p = 'LIVES_IN')
SELECT n0, n1, n2 FROM (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY n0) AS k FROM w WHERE split_part(c0, '-', 2)::BIGINT % 3 <> split_part(c1, '-', 2)::BIGINT % 3) WHERE k <= 4""")
def mined_chains(spark, sf_dir):
    """Chains with evidence from different filings, at most four a nation."""
    edges = G.edges(spark, sf_dir, "LIVES_IN", "PART_OF")
    ids = edges.select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    filing_of = ids.select("chunk_id", _text("f", F.split_part("chunk_id", F.lit("-"), F.lit(2)).cast("long") % 3).alias("accession"))
    found = questions.chains(edges, ["LIVES_IN", "PART_OF"], G.NAMES, filing_of, 1 << 30)
    return questions.quota(found, "n1", 4, [F.col("n0")]).select("n0", "n1", "n2")


@query("SELECT o_orderkey AS qid, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 5 THEN 1 ELSE 0 END::INTEGER AS named FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 3 AND l_quantity > 30)")
def absent_answers(spark, sf_dir):
    """Orders that a log of large lines lacks, and which of them the refusal to go on names."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"))
    log = table(spark, sf_dir, "lineitem").filter("l_linenumber < 3 and l_quantity > 30").select(F.col("l_orderkey").alias("qid"))
    try:
        reports.complete(asked, log)
        said = ""
    except ValueError as e:
        said = str(e)
    named = [int(x) for x in re.findall(r"\d+", said)]
    return reports.absent(asked, log).select("qid", F.col("qid").isin(named).cast("int").alias("named"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0")
def pending_filter(spark, sf_dir):
    """Rows with a log row, after a check that each key is known, less those that are done."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    done = orders.filter("o_orderkey % 3 = 0")
    logged = reports.complete(orders.select(F.col("o_orderkey").alias("qid"), "o_orderpriority"), orders.select(F.col("o_orderkey").alias("qid"))).select(F.col("qid").alias("o_orderkey"), "o_orderpriority")
    return logs.pending(logs.require_all(logged, orders, "o_orderkey"), done, "o_orderkey")
