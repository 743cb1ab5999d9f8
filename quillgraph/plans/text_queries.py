"""Text, resolution and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import chunking, context, evals, logs, resolve, routing, validate
from quillgraph.operators.components import connected_components
from quillgraph.plans.registry import Registry, table
from quillgraph.runtime import materialize, numbered
from quillgraph.schemas import RELATIONS, RISK_TOPICS, ontology

query = Registry()


@query("""WITH d AS (SELECT doc_id, trim(text, ' \t\n\r') AS t, length(trim(text, ' \t\n\r')) AS n FROM documents),
c AS (SELECT doc_id, t, n, greatest(0, ceil((n - 4000) / 3200.0))::BIGINT AS heads FROM d WHERE n > 0)
SELECT doc_id, i AS ordinal, substr(sha256(doc_id || '|' || i), 1, 16) AS chunk_id, length(CASE WHEN i < heads THEN substr(t, 3200 * i + 1, 4000) ELSE substr(t, 3200 * i + 1) END) AS n_chars
FROM (SELECT *, unnest(range(0, heads + 1)) AS i FROM c)""")
def chunk_hard_split(spark, sf_dir):
    rows = chunking.chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", "ordinal", "chunk_id", F.length("text").cast("long").alias("n_chars"))


KEEP_SQL = r"""WITH d AS (SELECT doc_id, source IN ('src1', 'src2') AS proxy, CASE WHEN doc_id % 3 = 0 THEN text || ' She has served since 2019 as a Director of the firm.' WHEN doc_id % 7 = 0 THEN text || ' Boards of 12345678901234567890' ELSE text END AS text FROM documents),
e AS (SELECT *, length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(regexp_replace(text, '\s', '', 'g')), 1) AS density FROM d)
SELECT doc_id, length(text) >= 300 AND (NOT proxy OR (regexp_matches(text, '(?i)(?:serve[sd]?|has served|currently serves)[^.]{0,60}(?:on the board|as a director|as director|board of directors)|\bdirector of\b|\bboard member of\b|\bboards? of\b|director nominee|election of directors|continuing directors') AND density < 0.25)) AS keep FROM e"""


@query(KEEP_SQL)
def chunk_keep_filter(spark, sf_dir):
    """Documents as chunks; those of two sources as proxies, some with a sentence on a board."""
    i = F.col("doc_id")
    said = F.when(i % 3 == 0, F.concat("text", F.lit(" She has served since 2019 as a Director of the firm."))).when(i % 7 == 0, F.concat("text", F.lit(" Boards of 12345678901234567890"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", chunking.keep(said, F.col("source").isin("src1", "src2")).alias("keep"))


PARAGRAPHS_SQL = r"""WITH p AS (SELECT doc_id, i, repeat(chr((97 + (doc_id + i) % 26)::INT) || ' ', 300 + (doc_id * 7 + i * 131) % 900) AS piece FROM (SELECT doc_id FROM documents WHERE doc_id % 20 = 0), (SELECT unnest(range(0, 9)) AS i)),
l AS (SELECT doc_id, list(piece ORDER BY i) AS pieces FROM p GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(list_prepend({'done': []::VARCHAR[], 'open': '', 'size': 0::BIGINT}, list_transform(pieces, lambda x: {'done': []::VARCHAR[], 'open': x, 'size': length(x)::BIGINT + 2})), lambda a, x:
    CASE WHEN a.size > 0 AND a.size + x.size - 2 > 4000 THEN {'done': list_append(a.done, a.open), 'open': right(a.open, 800) || chr(10) || chr(10) || x.open, 'size': 800 + x.size}
    WHEN a.size > 0 THEN {'done': a.done, 'open': a.open || chr(10) || chr(10) || x.open, 'size': a.size + x.size} ELSE x END) AS s FROM l),
c AS (SELECT doc_id, list_append(s.done, s.open) AS chunks FROM f)
SELECT doc_id, (i - 1)::BIGINT AS ordinal, substr(sha256(doc_id || '|' || (i - 1)), 1, 16) AS chunk_id, sha256(chunks[i]) AS digest FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM c)"""


@query(PARAGRAPHS_SQL)
def chunk_paragraphs(spark, sf_dir):
    """Texts of nine paragraphs, with blanks at their ends, as chunks."""
    i = F.col("doc_id")
    piece = lambda k: F.repeat(F.concat(F.char((97 + (i + k) % 26).cast("int")), F.lit(" ")), (300 + (i * 7 + k * 131) % 900).cast("int"))
    texts = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8)), piece), "\n \n").alias("text"))
    return chunking.chunk(texts, ["doc_id"]).select("doc_id", "ordinal", "chunk_id", F.sha2("text", 256).alias("digest"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '\n?Table of Contents\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g').trim(chr(10) || ' ') AS cleaned FROM pages")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean("html").alias("cleaned"))


@query(r"""SELECT item_id, doc_id FROM benchmark b JOIN documents d
ON contains(lower(trim(regexp_replace(d.text, '[ \t\n]+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '[ \t\n]+', ' ', 'g'))))""")
def evidence_check(spark, sf_dir):
    """Passages that a document quotes whole."""
    return validate.quoted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _triples(spark, sf_dir):
    """Relations made from the order lines, so that each reason occurs."""
    li = table(spark, sf_dir, "lineitem")
    names = ["SUPPLIES", "OFFERS", "EXPOSED_TO", "OFFICER_OF"]
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    kinds = F.array(F.lit("Company"), F.lit("Company"), F.lit("Person"), F.lit(None).cast("string"), F.lit("Company"))
    ends = F.array(F.lit("Company"), F.lit("Product"), F.lit("RiskTopic"), F.lit("Company"))
    s = F.concat(F.lit("x"), (F.col("l_suppkey") % 10).cast("string"))
    topic = F.when(F.col("l_partkey") % 2 == 0, F.lit(RISK_TOPICS[0])).otherwise("weather")
    kind = F.get(ends, (F.col("l_partkey") % 4).cast("int"))
    return li.select(
        F.get(F.array(*[F.lit(n) for n in names]), (k % 4).cast("int")).alias("predicate"), s.alias("subject"), F.get(kinds, (F.col("l_suppkey") % 5).cast("int")).alias("subject_type"), kind.alias("object_type"),
        F.when(kind == "RiskTopic", topic).otherwise(F.concat(F.lit("x"), (F.col("l_partkey") % 10).cast("string"))).alias("object"),
        F.when(F.col("l_quantity") > 45, "not there").when(F.col("l_quantity") < 3, "").otherwise("Some   Words").alias("evidence"), F.lit("there are some\nwords here").alias("text"),
    )


@query("""WITH t AS (SELECT ['SUPPLIES', 'OFFERS', 'EXPOSED_TO', 'OFFICER_OF'][((l_orderkey * 7 + l_linenumber) % 4 + 1)::INT] AS p, 'x' || (l_suppkey % 10) AS s, ['Company', 'Company', 'Person', NULL, 'Company'][(l_suppkey % 5 + 1)::INT] AS st,
    ['Company', 'Product', 'RiskTopic', 'Company'][(l_partkey % 4 + 1)::INT] AS ot, CASE WHEN l_partkey % 4 = 2 THEN CASE WHEN l_partkey % 2 = 0 THEN 'supply chain concentration' ELSE 'weather' END ELSE 'x' || (l_partkey % 10) END AS o,
    l_quantity > 45 AS lost FROM lineitem),
r AS (SELECT CASE WHEN st IS NULL THEN 'unknown_endpoint' WHEN s = o THEN 'self_loop'
    WHEN NOT ((p = 'SUPPLIES' AND st = 'Company' AND ot = 'Company') OR (p = 'OFFERS' AND st = 'Company' AND ot = 'Product') OR (p = 'EXPOSED_TO' AND st = 'Company' AND ot = 'RiskTopic') OR (p = 'OFFICER_OF' AND st = 'Person' AND ot = 'Company')) THEN 'type_signature'
    WHEN lost THEN 'evidence_not_found' WHEN ot = 'RiskTopic' AND o = 'weather' THEN 'unknown_risk_topic' ELSE 'kept' END AS reason FROM t)
SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 6) AS share FROM r GROUP BY reason""")
def relation_validation_reasons(spark, sf_dir):
    return validate.dropped(validate.reasons(_triples(spark, sf_dir), ontology(spark, RELATIONS)))


NORM = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(regexp_replace({x}, '\s*/[A-Za-z]{{2}}$', ''), '&', ' and ')), '[^a-z0-9_ ]', ' ', 'g'),
    '\b(?:inc|incorporated|corp|corporation|co|company|llc|ltd|limited|plc|nv|sa|ag|gmbh|holdings?|the)\b', ' ', 'g'), ' +', ' ', 'g')), '(?: [^ ])+$', '')"""
FORMS = ["Inc.", "& Co., Ltd.", "N.V. /DE", "Holdings plc", "(the) GmbH & Sons", "A B"]


@query("WITH v AS (SELECT name || ' ' || f AS surface FROM (SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer), (SELECT unnest([" + ", ".join(f"'{f}'" for f in FORMS) + "]) AS f)) SELECT surface, " + NORM.format(x="surface") + " AS norm FROM v")
def entity_normalize(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).union(table(spark, sf_dir, "customer").select("c_name")).distinct()
    v = names.select("name", F.explode(F.array(*[F.lit(f) for f in FORMS])).alias("f"))
    return v.select(F.concat_ws(" ", "name", "f").alias("surface")).withColumn("norm", X.normalize("surface"))


#: Names that a task makes norms of.
NAMES = 10_000


def _records(spark, sf_dir):
    """Suppliers as companies: two-word names from part names, some as initials or with a place."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    word = F.concat_ws(" ", "p_name", F.concat(F.lit("w"), (k % 97).cast("string")))
    surface = F.when(k % 11 == 0, F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 1), F.lit("w")))).when(k % 7 == 0, F.concat(word, F.lit(" Germany"))).when(k % 5 == 0, F.concat(word, F.lit(" Inc."))).otherwise(word)
    # a small file is one task's otherwise, and norms take long for their size
    dealt = part.repartition(max(1, part.count() // NAMES), "p_partkey")
    return materialize(dealt.select(k.alias("id"), F.lit("Company").alias("type"), surface.alias("surface")).withColumn("norm", X.normalize("surface")), "records")


RECORDS = f"""r0 AS (SELECT p_partkey AS id, p_name || ' w' || (p_partkey % 97) AS word, p_name FROM part),
r AS (SELECT id, surface, {NORM.format(x='surface')} AS norm FROM (SELECT id, CASE WHEN id % 11 = 0 THEN upper(p_name[1] || split_part(p_name, ' ', 2)[1] || 'w') WHEN id % 7 = 0 THEN word || ' Germany' WHEN id % 5 = 0 THEN word || ' Inc.' ELSE word END AS surface FROM r0)),
r2 AS (SELECT *, CASE WHEN norm LIKE '% %' THEN list_aggregate(list_transform(string_split(norm, ' '), lambda x: x[1]), 'string_agg', '') ELSE '' END AS acr,
    list_filter(string_split_regex(regexp_replace(lower(surface), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda x: x <> '') AS raw FROM r),
r3 AS (SELECT *, CASE WHEN len(raw) > 1 THEN list_aggregate(list_transform(raw, lambda x: x[1]), 'string_agg', '') ELSE '' END AS racr FROM r2),
keys AS (SELECT DISTINCT id, unnest(list_filter(['exact:' || norm, 'pre:' || norm[1:4], CASE WHEN acr <> '' THEN 'acr:' || acr END, CASE WHEN racr <> '' THEN 'acr:' || racr END,
    CASE WHEN norm NOT LIKE '% %' AND length(norm) BETWEEN 2 AND 6 AND surface = upper(surface) AND surface <> lower(surface) THEN 'acr:' || norm END], lambda x: x IS NOT NULL)) AS key FROM r3),
fair AS (SELECT key FROM keys GROUP BY key HAVING count(*) <= 400),
pairs AS (SELECT DISTINCT a.id AS i, b.id AS j FROM keys a JOIN keys b USING (key) JOIN fair USING (key) WHERE a.id < b.id)
"""


@query("WITH " + RECORDS + "SELECT * FROM pairs")
def blocking_candidates(spark, sf_dir):
    return resolve.candidates(_records(spark, sf_dir))


def _similar(i, j):
    """A stand-in for a model's cosine: fixed by the pair, so that both engines agree."""
    return ((i * 31 + j * 17) % 100) / 100.0


def _overrides(records):
    """Each norm and the next one in order: the same where the first has an even length."""
    norms = numbered(records.select("norm").distinct(), ["norm"])
    following = norms.select(F.col("norm").alias("b"), (F.col("place") - 1).alias("place"))
    return norms.join(following, "place").select(F.col("norm").alias("a"), "b", (F.length("norm") % 2 == 0).alias("same"))


def _rules(spark, sf_dir, records=None, locations=None, equal=True):
    """i, j, rule of the matching pairs; without ``equal``, records of one norm are linked to their first alone."""
    locations = spark.createDataFrame([], "norm string") if locations is None else locations
    records = _records(spark, sf_dir) if records is None else records
    side = resolve.with_overrides(resolve.marked(records, resolve.markers(locations)), _overrides(records))
    side = side if equal else materialize(side, "records", light=True)
    pairs = resolve.candidate_pairs(side, ["norm", "surface", "marks", "ours", "theirs"], equal=equal)
    found = pairs.withColumn("rule", resolve.rule("a", "b", resolve.overridden("a", "b"), _similar(F.col("i"), F.col("j")), F.array_union("a.marks", "b.marks"))).filter("rule is not null").select("i", "j", "rule")
    return found if equal else found.unionByName(resolve.equals(side).withColumn("rule", F.lit("exact")))


RULES = RECORDS + """, two AS (SELECT i, j, a.norm AS an, b.norm AS bn, a.acr AS aa, b.acr AS ba, a.racr AS ar, b.racr AS br, list_distinct(string_split(a.norm, ' ')) AS ta, list_distinct(string_split(b.norm, ' ')) AS tb FROM pairs JOIN r3 a ON a.id = i JOIN r3 b ON b.id = j),
ov AS (SELECT norm AS a, lead(norm) OVER (ORDER BY norm) AS b, length(norm) % 2 = 0 AS same FROM (SELECT DISTINCT norm FROM r)),
ruled AS (SELECT i, j, CASE WHEN coalesce(o1.same, o2.same) THEN 'override' WHEN coalesce(o1.same, o2.same) IS NOT NULL THEN NULL WHEN an = bn THEN 'exact'
    WHEN (length(an) >= 2 AND an NOT LIKE '% %' AND (ba = an OR br = an)) OR (length(bn) >= 2 AND bn NOT LIKE '% %' AND (aa = bn OR ar = bn)) THEN 'acronym'
    WHEN list_contains(ta, 'germany') <> list_contains(tb, 'germany') THEN NULL
    WHEN (i * 31 + j * 17) % 100 / 100.0 >= 0.88 AND len(list_intersect(ta, tb)) / len(list_distinct(ta || tb)) >= 0.67 THEN 'embedding' END AS rule FROM two LEFT JOIN ov o1 ON o1.a = an AND o1.b = bn LEFT JOIN ov o2 ON o2.a = bn AND o2.b = an)
"""


@query("WITH " + RULES + "SELECT * FROM ruled WHERE rule IS NOT NULL")
def match_rules(spark, sf_dir):
    return _rules(spark, sf_dir)


SURFACE = "CASE WHEN id % 11 = 0 THEN upper(p_name[1] || split_part(p_name, ' ', 2)[1] || 'w') WHEN id % 7 = 0 THEN word || ' Germany' WHEN id % 5 = 0 THEN word || ' Inc.' ELSE word END AS surface"
PLACES = "WHEN list_contains(ta, 'germany') <> list_contains(tb, 'germany') THEN NULL"
PLACED = "WHEN len(list_filter(list_distinct(ta || tb), lambda w: list_contains(ta, w) <> list_contains(tb, w) AND list_contains(['w0', 'w2', 'w4'], w))) > 0 THEN NULL"
MARKED = RULES.replace(SURFACE, "p_name || ' river stone mill w' || (id % 6) AS surface").replace(PLACES, PLACED)


@query("WITH " + MARKED + "SELECT * FROM ruled WHERE rule IS NOT NULL")
def match_rules_markers(spark, sf_dir):
    """Names that differ in a word: those in which it is a word of the corpus's own locations are set apart."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    surface = F.concat("p_name", F.lit(" river stone mill w"), (F.col("p_partkey") % 6).cast("string"))
    records = part.select(F.col("p_partkey").alias("id"), F.lit("Company").alias("type"), surface.alias("surface")).withColumn("norm", X.normalize("surface"))
    locations = nation.filter("n_nationkey < 3").select(F.concat(F.lit("w"), (F.col("n_nationkey") * 2).cast("string")).alias("norm"))
    return _rules(spark, sf_dir, records, locations)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS u, p_partkey + 1 AS v FROM part WHERE p_partkey % 7 NOT IN (0, 3) UNION SELECT p_partkey, p_partkey + 14 FROM part WHERE p_partkey % 91 = 5),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), reach(node, other) AS (SELECT u, u FROM s UNION SELECT node, v FROM reach JOIN s ON other = u)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def resolve_components(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    edges = p.filter(~(k % 7).isin(0, 3)).select(k.alias("u"), (k + 1).alias("v")).union(p.filter(k % 91 == 5).select(k, k + 14))
    return connected_components(edges)


@query("WITH RECURSIVE " + RULES + """, m AS (SELECT i AS u, j AS v FROM ruled WHERE rule IS NOT NULL), s AS (SELECT u, v FROM m UNION SELECT v, u FROM m), reach(node, other) AS (SELECT u, u FROM s UNION SELECT node, v FROM reach JOIN s ON other = u),
comp AS (SELECT r.id, r.norm, r.surface, coalesce(min(other), r.id) AS class, (1 + r.id % 4) AS n FROM r LEFT JOIN reach ON node = id GROUP BY r.id, r.norm, r.surface),
g AS (SELECT class, min(norm) AS low, arg_max(surface, struct_pack(a := n, b := -length(surface), c := -id)) AS name, list_sort(list_distinct(list(surface))) AS every, sum(n)::BIGINT AS mention_count FROM comp GROUP BY class)
SELECT substr(sha256('Company|' || low), 1, 16) AS canonical_id, name, array_to_string(list_filter(every, lambda x: x <> name), ';') AS aliases, mention_count FROM g""")
def entity_build(spark, sf_dir):
    records = _records(spark, sf_dir).withColumns({"n": 1 + F.col("id") % 4, "chunks": F.array(F.col("id").cast("string")), "ord": F.col("id")})
    built = resolve.entities(records, _rules(spark, sf_dir, equal=False))
    return built.select("canonical_id", "name", F.array_join("aliases", ";").alias("aliases"), "mention_count")


@query("WITH " + f"""e AS (SELECT s_suppkey AS id, p_name AS name, s_name AS alias, (s_suppkey * 37 % 50)::BIGINT AS n FROM supplier JOIN part ON p_partkey = s_suppkey),
x AS (SELECT id, n, {NORM.format(x='name')} AS norm FROM e UNION SELECT id, n, {NORM.format(x='alias')} FROM e)
SELECT norm, 'e' || lpad(id::VARCHAR, 8, '0') AS canonical_id, row_number() OVER (PARTITION BY norm ORDER BY n DESC, 'e' || lpad(id::VARCHAR, 8, '0')) AS rank FROM x WHERE norm <> ''""")
def alias_index_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    e = e.select(F.concat(F.lit("e"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("canonical_id"), (F.col("s_suppkey") * 37 % 50).alias("mention_count"), F.col("p_name").alias("name"), F.array("s_name").alias("aliases"))
    return routing.alias_index(e)


PLANS = """p AS (SELECT event_id, ['graph', 'vector', 'both', 'refuse'][(event_id % 4 + 1)::INT] AS route, CASE WHEN event_id % 5 = 0 THEN 'low' ELSE 'high' END AS confidence,
    (event_id // 3 % 4)::INT AS hops, (event_id // 7 % 4)::INT AS links, event_id // 11 % 3 > 0 AS anchored FROM events)"""


@query("WITH " + PLANS + """, a AS (SELECT *, hops <> links AS wrong, CASE WHEN hops <> links AND route = 'graph' THEN 'both' ELSE route END AS r1 FROM p),
b AS (SELECT *, r1 IN ('graph', 'both') AND NOT anchored AS lost, CASE WHEN r1 IN ('graph', 'both') AND NOT anchored THEN 'vector' ELSE r1 END AS r2 FROM a),
c AS (SELECT *, confidence = 'low' AND r2 IN ('graph', 'vector') AS unsure FROM b)
SELECT event_id, CASE WHEN unsure THEN 'both' ELSE r2 END AS final_route, CASE WHEN wrong THEN 0 ELSE links END::BIGINT AS chain_length,
    concat_ws('+', CASE WHEN wrong THEN 'chain_shape_mismatch' END, CASE WHEN lost THEN 'no_anchor' END, CASE WHEN unsure THEN 'low_confidence' END) AS degraded FROM c""")
def route_decide(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", pick(routing.ROUTES, i % 4).alias("route"), F.when(i % 5 == 0, "low").otherwise("high").alias("confidence"), pick(list(routing.SHAPES), F.floor(i / 3) % 4).alias("shape"),
        F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit(1), (F.floor(i / 7) % 4).cast("int")).alias("chain"), F.when(F.floor(i / 11) % 3 > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("node_ids"),
    )
    return routing.decide(rows).select("event_id", "final_route", F.size("final_chain").cast("long").alias("chain_length"), "degraded")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'refuse' WHEN event_id % 9 = 0 OR event_id % 4 >= 2 THEN 'both,graph' WHEN event_id % 3 = 0 THEN 'both,vector' ELSE 'both,graph,vector' END AS routes FROM events""")
def expected_route(spark, sf_dir):
    i = F.col("event_id")
    routes = routing.expected_routes(i % 4, F.when(i % 9 == 0, "aggregation"), F.when(i % 3 == 0, "hand").otherwise("mined"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(routes, ",").alias("routes"))


@query("""WITH c AS (SELECT o_orderkey, list_distinct(list('k' || l_partkey % 50 ORDER BY l_linenumber)) AS cited, list_sort(list_distinct(list('k' || l_suppkey % 40))) AS valid FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, array_to_string(list_sort(list_filter(cited, lambda x: NOT list_contains(valid, x))), ',') AS invented, len(list_filter(cited, lambda x: NOT list_contains(valid, x))) = 0 AS publishable FROM c""")
def citation_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = li.groupBy("o_orderkey").agg(F.collect_set(F.concat(F.lit(" [k"), (F.col("l_partkey") % 50).cast("string"), F.lit("] "))).alias("cited"), F.collect_set(F.concat(F.lit("k"), (F.col("l_suppkey") % 40).cast("string"))).alias("valid"))
    return c.select("o_orderkey", F.array_join(context.invented("cited", "valid"), ",").alias("invented"), context.publishable("cited", "valid").alias("publishable"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND NOT (value < 5 OR props LIKE '%"k": 1%')""")
def log_latest_row(spark, sf_dir):
    stale = (F.col("value") < 5) | F.col("props").contains('"k": 1')
    return logs.replay(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], stale).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return logs.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars")


WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


@query(r"""WITH t AS (SELECT doc_id, text || ' about 1,234 of nine and 007' AS x FROM documents),
n AS (SELECT doc_id, list_transform(regexp_extract_all(x, '\b\d[\d,]*\b'), lambda d: try_cast(replace(d, ',', '') AS BIGINT)) AS d, list_transform(list_filter(regexp_extract_all(lower(x), '[a-z]+'), lambda w: list_contains([""" + ", ".join(f"'{w}'" for w in WORDS) + "], w)), lambda w: list_position([" + ", ".join(f"'{w}'" for w in WORDS) + """], w) - 1) AS w FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(d || w, lambda v: v IS NOT NULL))), ',') AS numbers FROM n""")
def stated_numbers(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" about 1,234 of nine and 007")).alias("x"))
    return t.select("doc_id", F.array_join(F.transform(X.stated_numbers("x"), lambda v: v.cast("string")), ",").alias("numbers"))


@query("""WITH q AS (SELECT p_partkey, 'It sells ' || p_name || ', Inc. and more' AS answer, ['red ' || split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) || ' ring'] AS forms FROM part)
SELECT p_partkey, list_contains(list_transform(forms, lambda f: contains(' it sells ' || regexp_replace(split_part(answer, 'sells ', 2), ', Inc. and more', ' and more ') , ' ' || f || ' ')), true) AS named FROM q""")
def names_it_tokens(spark, sf_dir):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    q = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("It sells "), "p_name", F.lit(", Inc. and more")).alias("answer"), F.array(F.concat(F.lit("red "), second), F.concat(first, F.lit(" ring"))).alias("forms"))
    return q.select("p_partkey", X.names_it("answer", "forms").alias("named"))


LINES = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS running FROM lineitem) WHERE running <= 80")
def greedy_budget_prefix(spark, sf_dir):
    return context.budget_prefix(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER, F.col("l_quantity"), 80).select("l_orderkey", "l_partkey", "l_suppkey", "running")


@query(f"""WITH r AS (SELECT l_orderkey, l_partkey, {LINES} AS k FROM lineitem)
SELECT a.l_orderkey, a.l_partkey, coalesce(b.l_partkey, c.l_partkey) AS other FROM r a LEFT JOIN r b ON b.l_orderkey = a.l_orderkey AND b.k = a.k + 1 JOIN r c ON c.l_orderkey = a.l_orderkey AND c.k = 1""")
def negative_control_shift(spark, sf_dir):
    return evals.shifted(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER, "l_partkey").select("l_orderkey", "l_partkey", "other")
