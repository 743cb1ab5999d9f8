"""Graph queries over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import context, graph, routing
from quillgraph.plans import tpch_graph as G
from quillgraph.plans.registry import Registry
from quillgraph.runtime import BROADCAST_ROWS, if_small

query = Registry()
WITH = "WITH " + G.FACTS_SQL
#: Anchors: every supplier whose key is divisible by this, and so on.
ANCHOR = 20


def _anchors(spark, sf_dir, kind: str):
    key, source = {"s": ("s_suppkey", "supplier"), "c": ("c_custkey", "customer")}[kind]
    return G.table(spark, sf_dir, source).filter(F.col(key) % ANCHOR == 0).select(G._id(kind, key).alias("id"))


@query(WITH + "SELECT s AS subject_id, p AS predicate, o AS object_id, support, lo AS first_evidence, hi AS last_evidence, conf AS confidence FROM edges")
def edge_collapse(spark, sf_dir):
    return G.edges(spark, sf_dir).select("subject_id", "predicate", "object_id", "support", F.array_min("chunk_ids").alias("first_evidence"), F.array_max("chunk_ids").alias("last_evidence"), "confidence")


@query(WITH + "SELECT predicate, count(e.s) AS n FROM vocabulary LEFT JOIN edges e ON e.p = predicate GROUP BY predicate")
def edge_counts_by_relation(spark, sf_dir):
    return graph.counts_by_relation(G.edges(spark, sf_dir), G.vocabulary(spark))


def _paths_sql(start: str, chain: list[str], per_anchor: int) -> str:
    joins, nodes = "", ", ".join(f"e{k}.o AS node_{k}" for k in range(1, len(chain) + 1))
    for k, p in enumerate(chain[1:], 2):
        joins += f" JOIN edges e{k} ON e{k}.s = e{k - 1}.o AND e{k}.p = '{p}'"
    total = " + ".join(f"e{k}.support" for k in range(1, len(chain) + 1))
    least = "least(" + ", ".join(f"e{k}.support" for k in range(1, len(chain) + 1)) + ")"
    order = ", ".join(f"node_{k}" for k in range(1, len(chain) + 1))
    key, source = {"s": ("s_suppkey", "supplier"), "c": ("c_custkey", "customer")}[start]
    return (
        WITH + f", walks AS (SELECT e1.s AS anchor, {nodes}, {total} AS total_support, {least} AS min_support FROM edges e1{joins} "
        f"WHERE e1.p = '{chain[0]}' AND e1.s IN (SELECT '{start}:' || {key} FROM {source} WHERE {key} % {ANCHOR} = 0)) "
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY total_support DESC, {order}) AS rank FROM walks) WHERE rank <= {per_anchor}"
    )


@query(_paths_sql("s", ["SUPPLIES"], 200))
def path_one_hop(spark, sf_dir):
    return graph.paths(G.edges(spark, sf_dir, "SUPPLIES"), _anchors(spark, sf_dir, "s"), ["SUPPLIES"], G.NAMES, 200)


@query(_paths_sql("s", ["SUPPLIES", "BRANDED"], 20))
def path_two_hop(spark, sf_dir):
    return graph.paths(G.edges(spark, sf_dir, "SUPPLIES", "BRANDED"), _anchors(spark, sf_dir, "s"), ["SUPPLIES", "BRANDED"], G.NAMES, 20)


@query(_paths_sql("c", ["LIVES_IN", "PART_OF"], 20))
def path_nation_region(spark, sf_dir):
    return graph.paths(G.edges(spark, sf_dir, "LIVES_IN", "PART_OF"), _anchors(spark, sf_dir, "c"), ["LIVES_IN", "PART_OF"], G.NAMES, 20)


def _undirected(spark, sf_dir, buyers):
    """Purchases of buyers, and supplies read backwards as one more relation, so that a walk can go out and come back."""
    e = G.supports(spark, sf_dir, "BOUGHT", "SUPPLIES", "BASED_IN", "PART_OF", buyers=buyers)
    back = e.filter("predicate = 'SUPPLIES'").select(F.col("object_id").alias("subject_id"), F.lit("SUPPLIED_BY").alias("predicate"), F.col("subject_id").alias("object_id"), "support")
    return e.unionByName(back)


THREE = _paths_sql("c", ["BOUGHT", "SUPPLIED_BY", "BASED_IN"], 50).replace(" walks AS (", " both_ways AS (SELECT s, p, o, support FROM edges UNION ALL SELECT o, 'SUPPLIED_BY', s, support FROM edges WHERE p = 'SUPPLIES'), walks AS (").replace("FROM edges e1", "FROM both_ways e1").replace("JOIN edges e", "JOIN both_ways e")


@query(THREE)
def path_three_hop(spark, sf_dir):
    # purchases of others than the anchors are in no walk, so they are left out before they are gathered
    buyers = G.table(spark, sf_dir, "customer").filter(F.col("c_custkey") % ANCHOR == 0).select("c_custkey")
    small = ("BASED_IN",) if G.table(spark, sf_dir, "supplier").count() <= BROADCAST_ROWS else ()
    return graph.paths(_undirected(spark, sf_dir, if_small(buyers)), _anchors(spark, sf_dir, "c"), ["BOUGHT", "SUPPLIED_BY", "BASED_IN"], (*G.NAMES, "SUPPLIED_BY"), 50, G.line_tasks(spark, sf_dir), small)


WALK = WITH + f""", a AS (SELECT 's:' || s_suppkey AS anchor FROM supplier WHERE s_suppkey % {ANCHOR} = 0 UNION ALL SELECT 'n:' || n_nationkey FROM nation),
walk AS (
    SELECT anchor, true AS outbound, o AS neighbour, s, p, o, support FROM edges JOIN a ON s = anchor
    UNION ALL SELECT anchor, false, s, s, p, o, support FROM edges JOIN a ON o = anchor WHERE s <> o
)
"""


def _walk_anchors(spark, sf_dir):
    return _anchors(spark, sf_dir, "s").unionByName(G.table(spark, sf_dir, "nation").select(G._id("n", "n_nationkey").alias("id")))


@query(WALK + "SELECT anchor, outbound, neighbour, s AS subject_id, p AS predicate, o AS object_id, support FROM walk")
def neighbourhood_walk(spark, sf_dir):
    return graph.neighbourhood(G.edges(spark, sf_dir), _walk_anchors(spark, sf_dir)).select("anchor", "outbound", "neighbour", "subject_id", "predicate", "object_id", "support")


COUNTS = WALK + """, counts AS (
    SELECT anchor, p AS predicate, outbound, count(DISTINCT name) AS n, array_to_string(list_sort(list_distinct(list(name)))[1:8], '; ') AS examples
    FROM walk JOIN nodes ON id = neighbour GROUP BY ALL
)
"""


@query(COUNTS + "SELECT * FROM counts")
def neighbourhood_aggregate(spark, sf_dir):
    found = graph.neighbourhood_counts(G.edges(spark, sf_dir), _walk_anchors(spark, sf_dir), G.nodes(spark, sf_dir))
    return found.select("anchor", "predicate", "outbound", "n", F.array_join("examples", "; ").alias("examples"))


@query(COUNTS + """, said AS (
    SELECT anchor, n, predicate, outbound,
        CASE WHEN outbound THEN a.name || ' ' || phrase || ' ' || n || ' distinct ' || CASE WHEN object_type LIKE '%y' THEN regexp_replace(object_type, 'y$', 'ies') ELSE object_type || 's' END
            ELSE a.name || ' has ' || n || ' ' || noun END || ': ' || examples || CASE WHEN n > 8 THEN '; and ' || (n - 8) || ' others' ELSE '' END AS text
    FROM counts JOIN vocabulary USING (predicate) JOIN nodes a ON a.id = anchor WHERE n >= 2
) SELECT * EXCLUDE (predicate, outbound) FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, predicate, outbound DESC) AS rank FROM said) WHERE rank <= 12""")
def verbalised_aggregates(spark, sf_dir):
    nodes = G.nodes(spark, sf_dir)
    counts = graph.neighbourhood_counts(G.edges(spark, sf_dir), _walk_anchors(spark, sf_dir), nodes)
    named = counts.join(nodes.select(F.col("id").alias("anchor"), F.col("name").alias("anchor_name")), "anchor")
    return context.verbalise_aggregates(named, G.vocabulary(spark)).select("anchor", "rank", "text", "n")


SAID = _paths_sql("s", ["SUPPLIES", "BRANDED"], 20).replace("SELECT * FROM (SELECT *, row_number()", ", ranked AS (SELECT *, row_number()", 1).replace("AS rank FROM walks) WHERE rank <= 20", "AS rank FROM walks)") + """,
said AS (SELECT anchor, a.name || ' supplies ' || b.name || ' → ' || b.name || ' is branded ' || c.name AS text, min_support AS support, rank - 1 AS path
    FROM ranked JOIN nodes a ON a.id = anchor JOIN nodes b ON b.id = node_1 JOIN nodes c ON c.id = node_2 WHERE rank <= 20)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY anchor, text ORDER BY path) AS k FROM said) WHERE k = 1"""


@query(SAID)
def verbalised_paths(spark, sf_dir):
    edges, names = G.edges(spark, sf_dir, "SUPPLIES", "BRANDED"), G.nodes(spark, sf_dir).select("id", "name")
    walks = graph.paths(edges, _anchors(spark, sf_dir, "s"), ["SUPPLIES", "BRANDED"], G.NAMES, 20).withColumn("path", F.col("rank") - 1)
    hops = F.array(F.struct(F.lit(0).alias("hop"), F.lit("SUPPLIES").alias("predicate"), F.col("anchor").alias("s"), F.col("node_1").alias("o")), F.struct(F.lit(1).alias("hop"), F.lit("BRANDED").alias("predicate"), F.col("node_1").alias("s"), F.col("node_2").alias("o")))
    steps = walks.select("anchor", "path", F.explode(hops).alias("h")).select("anchor", "path", "h.*")
    steps = steps.join(edges.select(F.col("subject_id").alias("s"), "predicate", F.col("object_id").alias("o"), "chunk_ids", "support"), ["s", "predicate", "o"])
    steps = steps.join(names.select(F.col("id").alias("s"), F.col("name").alias("subject")), "s").join(names.select(F.col("id").alias("o"), F.col("name").alias("object")), "o")
    return context.verbalise(steps, G.vocabulary(spark), ["anchor"]).select("anchor", "text", "support", "path")


@query(WITH + """, pairs AS (SELECT a.o AS a, b.o AS b, a.s AS via FROM edges a JOIN edges b ON a.s = b.s AND a.p = 'BOUGHT' AND b.p = 'BOUGHT' AND a.o < b.o)
SELECT a, b, count(*) AS n, array_to_string(list_sort(list(via))[1:3], '; ') AS examples FROM pairs GROUP BY a, b ORDER BY n DESC, a, b LIMIT 50""")
def shared_neighbour(spark, sf_dir):
    return graph.shared_neighbour(G.edges(spark, sf_dir, "BOUGHT"), "BOUGHT", G.NAMES, 50).select("a", "b", "n", F.array_join("examples", "; ").alias("examples"))


@query(WITH + """SELECT e1.s AS start, e1.o AS a, e2.p AS p2, e2.o AS b, e3.p AS p3, e3.s AS c
FROM edges e1 JOIN edges e2 ON e2.s = e1.o AND e2.p IN ('BRANDED', 'PART_OF') JOIN edges e3 ON e3.o = e2.o AND e3.p IN ('BRANDED', 'PART_OF')
WHERE e1.p = 'BASED_IN' AND e1.o <> e2.o AND e3.s <> e1.o AND e3.s <> e2.o AND (e2.p <> e3.p OR e1.o <> e3.s) ORDER BY 1, 2, 3, 4, 5, 6 LIMIT 200""")
def pattern_three_hop_alternation(spark, sf_dir):
    return graph.pattern_three_hop(G.edges(spark, sf_dir, "BASED_IN", "BRANDED", "PART_OF"), "BASED_IN", ["BRANDED", "PART_OF"], ["BRANDED", "PART_OF"], G.NAMES, 200)


ORPHANS = WITH + ", touching AS (SELECT * FROM edges WHERE p IN ('BASED_IN', 'PART_OF')), orphan AS (SELECT id, name, type FROM nodes WHERE id NOT IN (SELECT s FROM touching UNION SELECT o FROM touching))\n"


@query(ORPHANS + "SELECT * FROM orphan")
def orphan_nodes(spark, sf_dir):
    return graph.orphans(G.nodes(spark, sf_dir), G.edges(spark, sf_dir, "BASED_IN", "PART_OF")).select("id", "name", "type")


@query(ORPHANS + "SELECT n_nodes, n_edges, 0::BIGINT AS n_loops, n_orphans, round(n_orphans / n_nodes::DOUBLE, 6) AS orphan_rate FROM (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM touching) AS n_edges, (SELECT count(*) FROM orphan) AS n_orphans)")
def graph_stats(spark, sf_dir):
    return graph.stats(G.nodes(spark, sf_dir), G.edges(spark, sf_dir, "BASED_IN", "PART_OF"))


@query(WITH + """, old AS (SELECT s, p, o, ev, conf, 0 AS batch FROM facts WHERE p = 'BASED_IN' OR (p = 'SUPPLIES' AND split_part(ev, '-', 2) <> '1')),
new AS (SELECT s, p, o, ev, conf, 1 AS batch FROM facts WHERE p = 'SUPPLIES' AND split_part(ev, '-', 2) IN ('1', '2')),
c AS (SELECT s, p, o, batch, CASE WHEN bool_or(conf = 'high') THEN 'high' ELSE arg_min(conf, ev) END AS conf FROM (FROM old UNION ALL FROM new) GROUP BY s, p, o, batch),
e AS (SELECT s, p, o, count(DISTINCT ev) AS support FROM (FROM old UNION ALL FROM new) GROUP BY s, p, o)
SELECT e.s AS subject_id, e.p AS predicate, e.o AS object_id, support, arg_max(conf, batch) AS confidence FROM e JOIN c USING (s, p, o) GROUP BY ALL""")
def edge_upsert(spark, sf_dir):
    facts, line = G.facts(spark, sf_dir, "SUPPLIES", "BASED_IN"), F.split_part("chunk_id", F.lit("-"), F.lit(2))
    old = graph.collapse(facts.filter((F.col("predicate") == "BASED_IN") | (line != "1")))
    new = graph.collapse(facts.filter((F.col("predicate") == "SUPPLIES") & line.isin("1", "2")))
    return graph.merge_edges(old, new, G.nodes(spark, sf_dir)).select("subject_id", "predicate", "object_id", "support", "confidence")


@query("""WITH new AS (SELECT s_suppkey AS key, s_name || ' (moved)' AS name, (s_nationkey + 1)::BIGINT AS place FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT -s_suppkey - 1, 'new ' || s_name, 0 FROM supplier WHERE s_suppkey % 10 = 0)
SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.key IS NULL THEN o.place ELSE n.place END AS place, o.vector
FROM (SELECT s_suppkey AS key, s_name AS name, s_nationkey::BIGINT AS place, s_acctbal AS vector FROM supplier) o FULL JOIN new n USING (key)""")
def passage_upsert(spark, sf_dir):
    s = G.table(spark, sf_dir, "supplier")
    old = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("place"), F.col("s_acctbal").alias("vector"))
    new = s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(" (moved)")).alias("name"), (F.col("s_nationkey") + 1).cast("long").alias("place"), F.lit(None).cast("double").alias("vector"))
    more = s.filter("s_suppkey % 10 = 0").select((-F.col("s_suppkey") - 1).alias("key"), F.concat(F.lit("new "), "s_name").alias("name"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("double").alias("vector"))
    return graph.merge_passages(old, new.unionByName(more), ["vector"], "key")


@query("""WITH pairs AS (SELECT DISTINCT l_suppkey AS e, l_orderkey AS c FROM lineitem)
SELECT c AS chunk_id, array_to_string(list_sort(list('s:' || e)), ',') AS entity_ids FROM pairs GROUP BY c""")
def chunk_entities(spark, sf_dir):
    rows = G.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_orderkey").alias("mention_chunks")).select(G._id("s", "l_suppkey").alias("canonical_id"), "mention_chunks")
    return graph.chunk_entities(rows).select("chunk_id", F.array_join("entity_ids", ",").alias("entity_ids"))


@query(WITH + """, ranked AS (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY support DESC, o) AS path FROM edges WHERE p = 'SUPPLIES'),
graph_ids AS (SELECT r.s, f.ev AS id, min(path) AS path FROM ranked r JOIN facts f ON f.s = r.s AND f.o = r.o AND f.p = 'SUPPLIES' GROUP BY r.s, f.ev),
g AS (SELECT s, list(id ORDER BY path, id)[1:6] AS ids FROM graph_ids GROUP BY s),
v AS (SELECT s, list(ev ORDER BY ev)[1:10] AS ids FROM (SELECT DISTINCT s, ev FROM facts WHERE p = 'SUPPLIES') GROUP BY s)
SELECT s AS anchor, array_to_string((g.ids || list_filter(v.ids, lambda x: NOT list_contains(g.ids, x)))[1:10], ',') AS merged FROM g JOIN v USING (s)""")
def ranked_merge(spark, sf_dir):
    from pyspark.sql import Window

    edges = G.edges(spark, sf_dir, "SUPPLIES")
    w = Window.partitionBy("subject_id").orderBy(F.desc("support"), "object_id")
    steps = edges.select(F.col("subject_id").alias("anchor"), F.row_number().over(w).alias("path"), F.lit(0).alias("hop"), "chunk_ids")
    g = routing.ids_of_steps(steps, ["anchor"], 6)
    v = G.facts(spark, sf_dir, "SUPPLIES").groupBy(F.col("subject_id").alias("anchor")).agg(F.slice(F.sort_array(F.collect_set("chunk_id")), 1, 10).alias("vector_ids"))
    return g.join(v, "anchor").select("anchor", F.array_join(routing.merge_ranked("ids", "vector_ids", 10), ",").alias("merged"))
