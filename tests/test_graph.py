import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import components, context, evals, graph, logs, models, questions, resolve, routing, vector
from quillgraph.operators.ask import ask
from quillgraph.operators.components import connected_components
from quillgraph.plans import store_queries, tpch_graph
from quillgraph.runtime import materialize
from quillgraph.schemas import ontology
from quillgraph.sources import jsonl, sections
from quillgraph.streaming import claims, merge

EDGE = "subject_id string, predicate string, object_id string, chunk_ids array<string>, support long, confidence string"


def edge(s, p, o, *ids, confidence="medium"):
    return s, p, o, list(ids), len(ids), confidence


@pytest.fixture(scope="module")
def edges(spark):
    rows = [edge("a", "SUPPLIES", "b", "1", "2"), edge("b", "SUPPLIES", "a", "3"), edge("b", "SUPPLIES", "c", "4", "5", "6"), edge("c", "OFFERS", "d", "7"), edge("e", "SUPPLIES", "e", "8")]
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, n, "Company") for i, n in (("a", "Ash"), ("b", "Birch"), ("c", "Cedar"), ("d", "Dogwood"), ("e", "Elm"), ("f", "Fir"))], "id string, name string, type string")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_collapse(spark):
    facts = [("a", "P", "b", "2", "medium", 1), ("a", "P", "b", "1", "low", 0), ("a", "P", "b", "2", "medium", 2), ("x", "P", "x", "3", "high", 3), ("c", "P", "d", "4", "low", 4), ("c", "P", "d", "5", "high", 5)]
    found = {(r.subject_id, r.object_id): (r.chunk_ids, r.support, r.confidence) for r in graph.collapse(spark.createDataFrame(facts, "subject_id string, predicate string, object_id string, chunk_id string, confidence string, ord long")).collect()}
    assert found == {("a", "b"): (["1", "2"], 2, "low"), ("c", "d"): (["4", "5"], 2, "high")}


def test_merging_twice_changes_nothing(spark, edges, nodes):
    once = graph.merge_edges(edges.limit(0), edges, nodes)
    twice = graph.merge_edges(once, edges, nodes)
    assert sorted(map(str, once.select(*edges.columns).collect())) == sorted(map(str, twice.select(*edges.columns).collect())) == sorted(map(str, edges.collect()))
    new = spark.createDataFrame([edge("a", "SUPPLIES", "b", "9", confidence="low"), edge("a", "SUPPLIES", "zz", "9")], EDGE)
    found = {(r.subject_id, r.object_id): r for r in graph.merge_edges(once, new, nodes).collect()}
    assert found["a", "b"].chunk_ids == ["1", "2", "9"] and found["a", "b"].confidence == "low" and ("a", "zz") not in found
    assert graph.merge_edges(once, new, nodes, full_refresh=True).count() == 1


def test_walks_may_return_but_not_repeat_an_edge(spark, edges):
    found = [(r.node_1, r.node_2, r.total_support, r.min_support) for r in graph.paths(edges, ids(spark, "a"), ["SUPPLIES", "SUPPLIES"], ["SUPPLIES"]).collect()]
    assert found == [("b", "c", 5, 2), ("b", "a", 3, 1)]
    assert graph.paths(edges, ids(spark, "e"), ["SUPPLIES", "SUPPLIES"], ["SUPPLIES"]).count() == 0
    with pytest.raises(ValueError):
        graph.paths(edges, ids(spark, "a"), ["EATS"], ["SUPPLIES"])


def test_neighbourhood_keeps_direction(spark, edges, nodes):
    found = {(r.outbound, r.subject_id, r.object_id) for r in graph.neighbourhood(edges, ids(spark, "b")).collect()}
    assert found == {(True, "b", "a"), (True, "b", "c"), (False, "a", "b")}
    assert graph.neighbourhood(edges, ids(spark, "e")).count() == 1
    same = nodes.withColumn("name", F.when(F.col("id") == "c", "Ash").otherwise(F.col("name")))
    counts = {r.outbound: r.n for r in graph.neighbourhood_counts(edges, ids(spark, "b"), same).collect()}
    assert counts == {True: 1, False: 1}  # names are counted, not ids


def test_orphans_and_stats(edges, nodes):
    assert [r.id for r in graph.orphans(nodes, edges).collect()] == ["f"]
    row = graph.stats(nodes, edges).first()
    assert (row.n_loops, row.n_orphans, row.orphan_rate) == (1, 1, 0.166667)
    assert graph.gate(graph.stats(nodes, edges), orphan_rate=0.3, n_loops=0) == ["n_loops"]


def test_inversion_and_store(spark):
    e = spark.createDataFrame([("y", ["1", "2"]), ("x", ["2"]), ("z", [])], "canonical_id string, mention_chunks array<string>")
    chunks = spark.createDataFrame([("1",), ("2",), ("3",)], "chunk_id string")
    assert {r.chunk_id: r.entity_ids for r in graph.store_rows(chunks, e).collect()} == {"1": ["y"], "2": ["x", "y"], "3": []}
    assert [r.chunk_id for r in graph.passages(["3", "9", "1"], chunks).collect()] == ["3", "1"]


def test_resolution_rules(spark):
    cases = [
        ("TRMC", "Taiwan River Mining Company", 0.0, "acronym"),  # before the marker rule
        ("Blue River Mining", "BRM", 0.0, "acronym"),
        ("Blue River, Inc.", "BLUE RIVER CORP", 0.0, "exact"),
        ("Blue River Works", "Blue River Germany Works", 0.99, None),
        ("Blue River Works", "Blue River Works Oy", 0.99, None),
        ("Blue River Mining Works", "Blue River Mining Group Works", 0.95, "embedding"),
        ("Blue River Mining Works", "Blue River Mining Group Works", 0.80, None),
        ("Advanced River Devices", "Advanced Energy Sources", 0.95, None),
    ]
    rows = [(a, b, c) for a, b, c, _ in cases]
    df = spark.createDataFrame(rows, "x string, y string, sim double")
    df = df.select(F.struct(F.col("x").alias("surface"), *[resolve.X.normalize("x").alias("norm")]).alias("a"), F.struct(F.col("y").alias("surface"), resolve.X.normalize("y").alias("norm")).alias("b"), "sim")
    words = {r.word for r in resolve.markers(spark.createDataFrame([("lyon",), ("the north",)], "norm string")).collect()}
    assert {"lyon", "germany", "oy"} <= words and not {"the", "north"} & words
    marks = F.array(*[F.lit(w) for w in sorted(words)])
    got = [r.rule for r in df.select(resolve.rule("a", "b", F.lit(None).cast("boolean"), F.col("sim"), marks).alias("rule")).collect()]
    assert got == [c[3] for c in cases]


def records(spark):
    rows = [(0, "Company", "Blue River Mining", [1.0, 0.0], ["c1"], 5), (1, "Company", "BRM", [0.0, 1.0], ["c2"], 1), (2, "Company", "Blue River Mining Inc.", [1.0, 0.0], ["c1", "c3"], 2), (3, "Person", "Blue River Mining", [1.0, 0.0], ["c4"], 1), (4, "Company", "Green Hill", [0.5, 0.5], ["c5"], 1)]
    df = spark.createDataFrame(rows, "id long, type string, surface string, embedding array<float>, chunks array<string>, n long")
    return df.withColumn("norm", resolve.X.normalize("surface")).withColumn("ord", F.col("id"))


def test_entities(spark):
    r = records(spark)
    none = spark.createDataFrame([], "a string, b string, same boolean")
    marks = resolve.markers(spark.createDataFrame([], "norm string"))
    built = {(x.type, x.name): x for x in resolve.entities(r, resolve.matches(r, none, marks)).collect()}
    assert set(built) == {("Company", "Blue River Mining"), ("Person", "Blue River Mining"), ("Company", "Green Hill")}
    one = built["Company", "Blue River Mining"]
    assert one.aliases == ["BRM", "Blue River Mining Inc."] and one.mention_chunks == ["c1", "c2", "c3"] and one.mention_count == 8
    assert len({x.canonical_id for x in built.values()}) == 3
    assert [x.n_aliases for x in resolve.largest(resolve.entities(r, resolve.matches(r, none, marks)), 1).collect()] == [2]
    for order in (("Blue River Mining", "BRM"), ("BRM", "Blue River Mining")):
        no = spark.createDataFrame([(*order, False)], "a string, b string, same boolean")
        rules = {(x.i, x.j): x.rule for x in resolve.matches(r, no, marks).collect()}
        assert (0, 1) not in rules and rules[0, 2] == "exact"
    yes = spark.createDataFrame([("BRM", "Green Hill", True)], "a string, b string, same boolean")
    assert (1, 4) not in {(x.i, x.j) for x in resolve.matches(r, yes, marks).collect()}  # blocking never made the pair


def test_boundary_pairs_of_one_gap(spark):
    """Rows of one pair that lie as far on both sides of the threshold give the less similar one, however they come."""
    rows = [("blue bolt", "blue bolt w1", x) for x in (0.89, 0.87)]
    for order in (rows, rows[::-1]):
        scored = spark.createDataFrame(order, "a string, b string, similarity double").coalesce(1)
        assert [r.similarity for r in resolve.boundary_pairs(scored).collect()] == [0.87]


def test_mined_pairs(spark):
    chunks = spark.createDataFrame([('We are Blue River Mining ("Blue") today.',)], "text string")
    names = spark.createDataFrame([("blue river mining",), ("blue",)], "norm string")
    declared = resolve.declared_pairs(chunks, names)
    assert [(r.b) for r in declared.collect()] == ["Blue"]
    listed = resolve.listed_pairs(spark.createDataFrame([("c", "Blue", ["A1", "B2", "C3"])], "chunk_id string, filer string, names array<string>"))
    assert listed.count() == 6
    hand = spark.createDataFrame([("Blue", "Blue River Mining", False)], "a string, b string, same boolean")
    mined = resolve.mine_pairs(hand, declared, listed, 3).collect()
    assert sum(r.source == "hand" for r in mined) == 1 and not any(r.source == "alias-declaration" for r in mined) and 1 <= sum(r.source.startswith("ex21") for r in mined) <= 3


def test_candidate_pairs_are_made_once(spark):
    """Pairs that share several keys are one row, without a shuffle of pairs; overrides hold in either order."""
    names = ["Acme Works North", "Acme Works North", "Acme Works", "AWN", "Acme Mill", "Zed", "zed", "Acme Works North"]
    records = spark.createDataFrame([(n, "C" if n < 7 else "D", s) for n, s in enumerate(names)], "id long, type string, surface string").withColumn("norm", X.normalize("surface"))
    keys = {r.id: {(r.type, k) for k in r.keys} for r in records.select("id", "type", X.blocking_keys("norm", "surface").alias("keys")).collect()}
    want = sorted((i, j) for i in keys for j in keys if i < j and keys[i] & keys[j])
    pairs = resolve.candidates(records)
    assert sorted((r.i, r.j) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
    side = resolve.with_overrides(records, spark.createDataFrame([("Zed", "Acme Mill", True), ("Acme Works", "Acme Mill", False)], "a string, b string, same boolean"))
    a, b = (side.select(F.col("id").alias(c), F.struct("norm", "ours", "theirs").alias(c + "r")) for c in "ab")
    found = a.join(b, F.col("a") != F.col("b")).withColumn("same", resolve.overridden("ar", "br")).filter("same is not null")
    assert sorted((r.a, r.b, r.same) for r in found.collect()) == [(2, 4, False), (4, 2, False), (4, 5, True), (4, 6, True), (5, 4, True), (6, 4, True)]


@pytest.mark.parametrize("block", [512, 3])
def test_repeated_names_of_a_list_meet_once(spark, monkeypatch, block):
    """Each pair is one row, however often its names are repeated in a list or in others."""
    monkeypatch.setattr(resolve, "LIST", block)
    names = [f"n{k % 7}" for k in range(40)] + ["last", None, "F"]
    got = [tuple(r) for r in resolve.listed_pairs(spark.createDataFrame([("c", "F", names), ("d", "G", ["n0", "n1", "new"])], "chunk_id string, filer string, names array<string>")).collect()]
    want = {("F", n, "ex21-parent") for n in names if n and n != "F"}
    want |= {(a, b, "ex21-sibling") for k, a in enumerate(names) for b in names[k + 1 :]}
    want |= {("G", n, "ex21-parent") for n in ("n0", "n1", "new")} | {("n0", "new", "ex21-sibling"), ("n1", "new", "ex21-sibling")}
    assert sorted(got, key=str) == sorted(want, key=str)
    mined = resolve.mine_pairs(*[spark.createDataFrame([], "a string, b string, same boolean")] * 2, spark.createDataFrame(got, "a string, b string, source string"), 10)
    places = sorted(want, key=lambda r: tuple(x or "" for x in r))
    stride = [places[int(i * len(places) / 10)] for i in range(10)]
    assert {frozenset((r.a, r.b)) for r in mined.collect()} == {frozenset((a, b)) for a, b, _ in stride if a and b and a != b}


def test_components_of_long_chain_and_star(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1400)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(301)) and all(found[j] == 1000 for j in range(1000, 1400))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_topk_and_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id long, embedding array<float>").repartition(5)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {q: sorted((-round(float(u[q] @ u[i]), 5), i) for i in range(300) if i != q)[:4] for q in range(0, 300, 30)}
    for size in (vector.QUERIES, 3):
        monkeypatch.setattr(vector, "QUERIES", size)
        got = {}
        for r in vector.topk(df, df.filter("id % 30 = 0"), 4, 8).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id))
        assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_ann_reaches_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.filter("id % 20 = 0")
    assert vector.recall(vector.ann(e, asked, 10, 64), vector.topk(e, asked, 10, 64)).first().recall >= 0.9


@pytest.mark.parametrize(
    "plan,want",
    [
        (("graph", "high", "two_hop", ["A", "B"], ["x"]), ("graph", ["A", "B"], "")),
        (("graph", "high", "two_hop", ["A"], ["x"]), ("both", [], "chain_shape_mismatch")),
        (("graph", "high", "one_hop", ["A"], []), ("vector", ["A"], "no_anchor")),
        (("both", "low", "one_hop", ["A"], []), ("both", ["A"], "no_anchor+low_confidence")),
        (("vector", "low", "none", [], []), ("both", [], "low_confidence")),
        (("refuse", "low", "none", [], []), ("refuse", [], "")),
    ],
)
def test_decide(spark, plan, want):
    r = routing.decide(spark.createDataFrame([plan], "route string, confidence string, shape string, chain array<string>, node_ids array<string>")).first()
    assert (r.final_route, r.final_chain, r.degraded) == want


def test_alias_index(spark):
    e = spark.createDataFrame([("1", "Blue River Inc.", ["BRM"], 3), ("2", "BLUE RIVER", [], 9), ("3", "Green Hill Works", [], 1)], "canonical_id string, name string, aliases array<string>, mention_count long")
    index = routing.alias_index(e)
    asked = spark.createDataFrame([("blue river",), ("BRM",), ("the green works",), ("nothing",)], "surface string")
    assert {r.surface: r.canonical_id for r in routing.resolve_names(asked, index).collect()} == {"blue river": "2", "BRM": "1", "the green works": "3", "nothing": None}


@pytest.mark.parametrize("held,small", [(200_000, 200_000), (3, 200_000), (3, 0)])
@pytest.mark.parametrize("kind", ["long", "string", "struct<a: long, b: string>"])
def test_components_are_the_brute_force(spark, monkeypatch, kind, held, small):
    """Whatever a task contracts, and for nodes of any ordered type."""
    monkeypatch.setattr(components, "HELD", held)
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(len(kind) + held)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(n, n + 1) for n in range(200, 240)] + [(300, n) for n in range(301, 360)] + [(5, 5), (6, 6)]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    named = {"long": lambda n: n, "string": lambda n: f"é{n:05d}"}.get(kind, lambda n: (n, "x"))
    edges = spark.createDataFrame([(named(a), named(b)) for a, b in pairs] + [(None, named(1))], f"u {kind}, v {kind}").repartition(4)
    found = {(tuple(r.node) if kind[0:6] == "struct" else r.node): (tuple(r.component) if kind[0:6] == "struct" else r.component) for r in connected_components(edges).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert found == {named(n): named(find(n)) for n in linked}


STEP = "path long, hop long, subject string, predicate string, object string, chunk_ids array<string>, support long"


def test_verbalise(spark):
    steps = [(0, 0, "Ash", "SUPPLIES", "Birch", ["1", "2"], 5), (0, 1, "Birch", "OFFERS", "Nut", ["3", "1"], 2), (1, 0, "Elm", "ACQUIRED", "Fir", ["4"], 1), (2, 0, "Elm", "ACQUIRED", "Fir", ["5"], 9)]
    found = context.verbalise(spark.createDataFrame(steps, STEP), ontology(spark), []).orderBy("path").collect()
    assert [(r.text, r.chunk_ids, r.support) for r in found] == [("Ash supplies Birch → Birch offers Nut", ["1", "3", "2"], 2), ("Elm acquired Fir", ["4"], 1)]
    assert len(context.verbalise(spark.createDataFrame(steps, STEP), ontology(spark), [], 1).collect()) == 1


def test_counts_are_said_both_ways(spark):
    rows = [("a", "Ash", "ACQUIRED", True, 9, [f"N{i}" for i in range(8)], ["1"]), ("a", "Ash", "SUPPLIES", False, 2, ["X", "Y"], ["2"]), ("a", "Ash", "OFFERS", True, 1, ["Z"], ["3"])]
    found = [r.text for r in context.verbalise_aggregates(spark.createDataFrame(rows, "anchor string, anchor_name string, predicate string, outbound boolean, n long, examples array<string>, chunk_ids array<string>"), ontology(spark)).orderBy("rank").collect()]
    assert found == ["Ash acquired 9 distinct Companies: N0; N1; N2; N3; N4; N5; N6; N7; and 1 others", "Ash has 2 suppliers: X; Y"]


def test_only_what_is_shown_may_be_cited(spark):
    kind = "facts array<struct<text: string, chunk_ids: array<string>>>, aggs array<struct<text: string, chunk_ids: array<string>>>, ps array<struct<chunk_id: string, text: string>>"
    df = spark.createDataFrame([([("f", ["1", "2", "3", "4"])], [], [("9", "body")])], kind)
    text, valid = context.build_context(F.col("facts"), F.col("aggs"), F.col("ps"))
    r = df.select(text.alias("t"), valid.alias("v")).first()
    assert r.v == ["1", "2", "3", "9"] and "Counts" not in r.t and all(i in r.t for i in r.v) and "4" not in r.t
    c = spark.createDataFrame([(["[1] ", "2"], ["1", "2"]), (["7", "1"], ["1"]), ([], ["1"])], "c array<string>, v array<string>")
    assert [(r.i, r.p) for r in c.select(context.invented("c", "v").alias("i"), context.publishable("c", "v").alias("p")).collect()] == [([], True), (["7"], False), ([], False)]


def test_replay_evicts(spark):
    log = spark.createDataFrame([(1, "m", "q1", "new", None), (2, "m", "q1", "old", None), (1, "m", "q2", "old", None), (2, "m", "q2", "new", None), (1, "m", "q3", "new", None), (2, "m", "q3", "new", "unreachable"), (1, "x", "q1", "new", None)], "seq long, model string, qid string, sha string, reason string")
    stale = (F.col("sha") != "new") | F.coalesce(F.col("reason").contains("unreachable"), F.lit(False))
    assert {(r.model, r.qid) for r in logs.replay(log, ["model", "qid"], ["seq"], stale).collect()} == {("m", "q2"), ("x", "q1")}


def test_keys_ignore_unset_options():
    assert logs.fingerprint("p", {"a": 1}) == logs.fingerprint("p", {"a": 1}, effort=None) != logs.fingerprint("p", {"a": 1}, effort="low")
    assert models.cache_key("chat", "x") != models.cache_key("embed", "x") and len(models.cache_key("chat", "x")) == 64


def test_key_score(spark):
    rows = [(0, None, True, [], None, "", 1.0), (0, None, False, [], None, "x", 0.0), (1, "aggregation", False, [], 9, "It has nine.", 1.0), (1, "aggregation", True, [], 9, "nine", 0.0), (1, None, False, [], None, "x", None), (2, None, False, ["Blue River Inc"], None, "By blue river.", 1.0), (2, None, True, ["Blue River"], None, "Blue River", 0.0)]
    df = spark.createDataFrame([r[:6] for r in rows], "hops long, category string, refused boolean, expected array<string>, n long, answer string")
    got = [r.s for r in df.select(evals.key_score(F.col("hops"), F.col("category"), F.col("refused"), F.col("expected"), F.col("n"), F.col("answer")).alias("s")).collect()]
    assert got == [r[6] for r in rows]


def test_strata_and_gate(spark):
    df = spark.createDataFrame([(1, None, "mined", 0.6), (1, "aggregation", "hand", 0.0), (2, None, "mined", 0.0)], "hops long, category string, source string, recall double")
    means = {r.stratum: (r.n, r["mean"]) for r in evals.by_stratum(df.withColumn("strata", evals.strata(F.col("hops"), F.col("category"), F.col("source"))), "recall").collect()}
    assert means == {"1-hop": (1, 0.6), "2-hop": (1, 0.0), "aggregation": (1, 0.0), "hand": (1, 0.0), "all": (3, 0.2)}
    assert evals.floor_gate(df) == 0.6
    for bad in (df.withColumn("recall", F.lit(0.03)), df.filter("hops = 2")):
        with pytest.raises(ValueError):
            evals.floor_gate(bad)


def test_percentile_index(spark):
    for n in (1, 2, 20, 41):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
        want = sorted(float(i) for i in range(n))[int(n * 0.95) - 1]
        assert df.agg(evals.index_p95("x").alias("p")).first().p == want
        assert evals.latency(df.withColumn("k", F.lit(1)), ["k"], "x").first().p95 == want


def test_bootstrap_draws_as_a_serial_run_does(spark):
    import random

    diffs = {"a": [0.0, 1.0, -1.0, 1.0, 0.0, 1.0, 1.0], "b": [1.0, 0.0, -1.0]}
    rng, want = random.Random(0), []
    for name in ("a", "b"):
        d, n = diffs[name], len(diffs[name])
        boots = sorted(sum(d[rng.randrange(n)] for _ in range(n)) / n for _ in range(1000))
        want.append((name, boots[25], boots[975]))
    df = spark.createDataFrame([(k, i, x) for k, v in diffs.items() for i, x in enumerate(v)], "stratum string, ord long, diff double")
    assert [(r.stratum, r.low, r.high) for r in evals.bootstrap(df, ["a", "b"], 1000).collect()] == want


def test_bootstrap_is_fixed(spark):
    df = spark.createDataFrame([("all", i, float(i % 3 - 1 + (i % 2))) for i in range(30)], "stratum string, ord long, diff double")
    a, b = (evals.bootstrap(df, ["all", "none"], 500).collect() for _ in range(2))
    assert a == b and len(a) == 1 and a[0].low <= a[0].delta <= a[0].high


def test_shift_and_questions(spark, edges, nodes):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "g string, x long")
    assert {r.x: r.other for r in evals.shifted(rows, ["g"], ["x"], "x").collect()} == {1: 2, 2: 3, 3: 1}
    templates = spark.createDataFrame([("SUPPLIES", "Whom does {subject} supply, {object}?", "object"), ("OFFERS", "{subject}?", None)], "predicate string, template string, side string")
    mined = questions.one_hop(edges, nodes, templates, 1).collect()
    assert len(mined) == 2 and all("{" not in r.question for r in mined) and sorted(len(r.expected_answers) for r in mined) == [0, 1]
    filing = spark.createDataFrame([(str(i), f"f{i % 2}") for i in range(9)], "chunk_id string, accession string")
    walks = questions.chains(edges, ["SUPPLIES", "SUPPLIES"], ["SUPPLIES"], filing, 5).collect()
    assert [(r.n0, r.n1, r.n2) for r in walks] == [("a", "b", "c")]
    one_filing = filing.withColumn("accession", F.lit("f"))
    assert questions.chains(edges, ["SUPPLIES", "SUPPLIES"], ["SUPPLIES"], one_filing, 5).count() == 0
    assert questions.chains(edges, ["SUPPLIES", "OFFERS"], ["SUPPLIES", "OFFERS"], filing, 5).count() == 1
    q = spark.createDataFrame([("x", ["1", "77"])], "qid string, gold_chunk_ids array<string>")
    assert [r.chunk_id for r in questions.known(q, filing).collect()] == ["77"]


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "log")
    assert jsonl.read(spark, path, "a long").count() == 0
    assert jsonl.write(spark.range(3).select(F.col("id").alias("a")), path) == 3 and jsonl.append(spark.range(2).select(F.col("id").alias("a")), path) == 2
    assert jsonl.read(spark, path, "a long").count() == 5
    (tmp_path / "blank.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert jsonl.read(spark, str(tmp_path / "blank.json"), "a long").count() == 2


def test_sections(spark):
    kind = "ticker string, company string, cik long, form string, accession string, filing_date date, sections map<string, string>, exhibits array<struct<kind: string, text: string>>"
    import datetime

    day = lambda d: datetime.date(2024, 1, d)
    rows = [("T", "C", 1, "10-K", f"k{d}", day(d), {"Item 1": "w " * 200, "Item 9": "w " * 200, "Item 3": "short"}, [("EX-10", "no"), ("EX-21.1", "z " * 200), ("EX-21.2", "y " * 200)]) for d in (1, 2)]
    rows += [("T", "C", 1, "8-K", f"e{d:02}", day(d), {"Item 5.02": "w " * 200, "Item 9.01": "w " * 200}, []) for d in range(1, 11)]
    filings = sections.newest(spark.createDataFrame(rows, kind))
    assert filings.count() == 9
    docs = sections.flatten(filings).collect()
    proxy = spark.createDataFrame([("T", "C", 1, "DEF 14A", "p1", day(3), {"whole": "w " * 200}, [])], kind)
    assert [d.section_path for d in sections.flatten(proxy).collect()] == ["DEF 14A"]
    assert sorted({d.section_path for d in docs}) == ["10-K/EX-21", "10-K/Item 1", "8-K/Item 5.02"] and len(docs) == 10
    manifest = spark.createDataFrame([("T", ["k2"])], "ticker string, accessions array<string>")
    assert sections.pinned(filings, manifest).count() == 1 and sections.not_done(filings, manifest).count() == 0


REPLY = json.dumps({"reasoning": 'a "claims" of {sorts}', "answerable": True, "claims": [{"text": 'one } "x" \\ {', "citations": ["1"]}, {"text": "two", "citations": ["zz"]}, {"text": "three", "citations": []}], "after": [{"text": "no"}]})


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scanner(size):
    scanner, found = claims.ClaimScanner(), []
    text = REPLY.replace('a \\"claims\\" of {sorts}', "why {not}")
    for i in range(0, len(text), size):
        scanner = claims.ClaimScanner(scanner.state())
        found += scanner.feed(text[i : i + size])
    assert [c["text"] for c in found] == ['one } "x" \\ {', "two", "three"]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scanner_on_odd_replies(size):
    replies = {
        '{"claims": [], "after": [{"text": "no"}]}': [],
        '{"x": [{"text": "no"}], "claims" :\n [ {"text": "a", "more": {"b": [1, {"c": "]}"}]}} , {"text": "\\\\"},{"text": "\\""}]}': ["a", "\\", '"'],
        '{"claims": [{"text": bad}, {"text": "good"}]} {"claims": [{"text": "late"}]}': ["good"],
        '{"claims": [{"text": "open': [],
        "": [],
    }
    for reply, want in replies.items():
        scanner, found = claims.ClaimScanner(), []
        for i in range(0, len(reply), size):
            found += scanner.feed(reply[i : i + size])
        assert [c["text"] for c in found] == want


def test_event_order(spark):
    requests = spark.createDataFrame([("a", "graph", ["2", "1"], None, None), ("b", "refuse", [], "router_refused", None), ("c", "vector", ["9"], None, "down")], "request_id string, route string, citable array<string>, reason string, error string")
    kept = spark.createDataFrame([("a", 0, "one", ["1"]), ("a", 2, "two", ["2"])], claims.OUTPUT)
    log = claims.event_log(requests, kept).orderBy("request_id", "seq").collect()
    assert [(r.request_id, r.seq, r.event.split("\n")[0].split(": ")[1]) for r in log] == [("a", 0, "retrieved"), ("a", 1, "claim"), ("a", 2, "claim"), ("a", 3, "done"), ("b", 0, "retrieved"), ("b", 1, "done"), ("c", 0, "retrieved"), ("c", 1, "error")]
    assert json.loads(log[0].event.split("data: ")[1]) == {"route": "graph", "citable": ["1", "2"]}
    assert json.loads(log[5].event.split("data: ")[1]) == {"answerable": False, "refusal_reason": "router_refused"}
    lines = spark.createDataFrame([("a", 0, ": keep-alive"), ("a", 1, 'data: {"choices": [{"delta": {"content": "x\\ny"}}]}'), ("a", 2, 'data: {"choices": [{"delta": {}}]}'), ("a", 3, "data: [DONE]")], "request_id string, seq long, line string")
    assert [(r.seq, r.delta) for r in claims.deltas(lines).collect()] == [(1, "x\ny")]


def test_only_checked_claims_are_published(spark):
    found = spark.createDataFrame([("r", 0, "one", ["[1]"]), ("r", 1, "two", ["zz"]), ("r", 2, "three", [])], claims.OUTPUT)
    valid = spark.createDataFrame([("r", ["1", "2"])], "request_id string, valid_ids array<string>")
    kept = claims.published(found, valid)
    assert [r.text for r in kept.collect()] == ["one"] and claims.events(kept).first().event.startswith("event: claim\ndata: {")


def test_upsert_stream(spark, tmp_path, edges, nodes):
    edges.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = merge.Bucketed(spark, str(tmp_path / "table"), EDGE, ["subject_id", "predicate", "object_id"], 4)
    for _ in range(2):
        stream = spark.readStream.schema(EDGE).parquet(str(tmp_path / "in"))
        merge.upsert_stream(stream, table, lambda old, new: graph.merge_edges(old, new, nodes).select("subject_id", "predicate", "object_id", "chunk_ids", "support", "confidence"), str(tmp_path / "log")).awaitTermination()
    assert table.read().count() == 5


def test_meter_and_retries():
    meter = models.Meter({"m": (1.0, 2.0)}, (10.0, 10.0), budget=5.0)
    assert meter.add("m", 1_000_000, 1_000_000) == 3.0
    with pytest.raises(models.OverBudget):
        meter.add("other", 1_000_000, 0)
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("no")
        return "yes"

    assert models.retried(flaky, sleep=waits.append) == "yes" and len(waits) == 2
    now = [0.0]
    pacer = models.Pacer(60, clock=lambda: now[0], sleep=waits.append)
    assert pacer.wait() == 0 and pacer.wait() == 1.0 and pacer.waited == 1.0


def test_synthesis_repairs_citations():
    replies = [{"answerable": True, "claims": [{"text": "x", "citations": ["bad"]}]}, {"answerable": True, "claims": [{"text": "x", "citations": ["[1]"]}]}]
    seen = []

    def chat(system, user, schema):
        seen.append(user)
        return json.dumps(replies[len(seen) - 1])

    found = models.synthesise("q", "ctx", {"1"}, chat, "", {})
    assert found["answerable"] and found["attempts"] == 2 and "bad" in seen[1]
    always = lambda s, u, k: json.dumps({"answerable": True, "claims": [{"text": "x", "citations": []}]})
    assert models.synthesise("q", "ctx", {"1"}, always, "", {})["refusal_reason"] == "citation_unrecoverable"
    assert models.synthesise("q", "", set(), always, "", {})["refusal_reason"] == "no_context"
    assert models.synthesise("q", "c", set(), lambda *a: "[", "", {})["refusal_reason"] == "synthesiser_invalid_answer"

    def down(*_):
        raise TimeoutError

    assert models.synthesise("q", "c", set(), down, "", {})["refusal_reason"].startswith("synthesiser_unreachable")
    assert models.make_plan("q", down, "", {})[0].route == "vector" and models.judge("q", "r", "a", down, "", {}) == "ungraded"


def test_embedding_reads_the_cache_first(spark):
    chunks = spark.createDataFrame([("1", "a b"), ("2", "c")], "chunk_id string, text string")
    cache = spark.createDataFrame([("1", [9.0]), ("7", [1.0])], "chunk_id string, embedding array<float>")
    found = {r.chunk_id: r.embedding for r in models.embed_missing(chunks, cache, models.fake_embed).collect()}
    assert set(found) == {"1", "2"} and found["1"] == [9.0] and len(found["2"]) == models.DIMENSIONS


def test_extract_quarantines(spark):
    def chat(system, user, schema):
        if "boom" in user:
            raise RuntimeError("down")
        return '{"mentions": []}' if "rejected" in user else "not json"

    chunks = spark.createDataFrame([("1", "fine"), ("2", "boom")], "chunk_id string, text string")
    found = {r.chunk_id: r for r in models.extract(chunks, chat, "", {}, "struct<mentions: array<string>>").collect()}
    assert found["1"].attempts == 2 and found["1"].extraction is not None and found["2"].error.startswith("RuntimeError")


def test_ask(spark, edges, nodes):
    store = spark.createDataFrame([(str(i), f"text of {i}") for i in range(1, 9)], "chunk_id string, text string")
    vectors = {r.chunk_id: models.fake_embed([r.text])[0] for r in store.collect()}
    store = spark.createDataFrame([(r.chunk_id, r.text, vectors[r.chunk_id]) for r in store.collect()], "chunk_id string, text string, embedding array<float>")
    index = routing.alias_index(nodes.select(F.col("id").alias("canonical_id"), "name", F.array().cast("array<string>").alias("aliases"), F.lit(1).cast("long").alias("mention_count")))

    def run(plan, **more):
        chat = lambda system, user, schema: json.dumps(plan) if system == "plan" else json.dumps({"answerable": True, "claims": [{"text": "t", "citations": ["4"] if "[4" in user else ["8"]}]})
        return ask("text of 8", chat=chat, embed=models.fake_embed, store=store, nodes=nodes, edges=edges, index=index, prompts={"plan": "plan", "answer": "answer"}, **more)

    one = run({"route": "graph", "confidence": "high", "entities": ["Ash"], "shape": "two_hop", "chain": ["SUPPLIES", "SUPPLIES"]})
    assert one["route"] == "graph" and one["facts"][0]["text"] == "Ash supplies Birch → Birch supplies Cedar" and one["answer"]["answerable"] and one["ids"][0] == "1"
    two = run({"route": "both", "confidence": "high", "entities": ["Birch"], "shape": "none", "chain": []})
    assert two["counts"][0]["text"].startswith("Birch supplies 2 distinct Companies: Ash; Cedar")
    three = run({"route": "graph", "confidence": "high", "entities": ["Nobody"], "shape": "none", "chain": []})
    assert three["route"] == "vector" and three["ids"][0] == "8"
    assert run({"route": "refuse"})["answer"]["refusal_reason"] == "router_refused"


def test_numbers_over_partitions(spark):
    from quillgraph.runtime import numbered

    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)] + [(None, 99), (None, 98)], "x long, y long").repartition(6)
    rows = numbered(df, ["x", "y"]).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(52)) and [r.x for r in rows] == [None, None, *range(50)]
    assert [r.x for r in questions.sample_strided(df.filter("x is not null"), ["x"], 5).orderBy("x").collect()] == [0, 10, 20, 30, 40]


def test_equal_names_are_linked_not_paired(spark):
    """100 copies of a name are 99 links instead of 4950 pairs; classes are those of all pairs, whatever keys are too full and whatever an override says of a norm and itself."""
    names = ["Ash Stone"] * 100 + ["Ash Stone Inc.", "ASI", "Ash Stones", "Birch Hill", "Birch Hill", "Elm Ltd", "Elm Inc"] + ["Oak Pond Holdings"] * 3 + ["Oak Pond"] * 6
    records = spark.createDataFrame([(i, "Company", n) for i, n in enumerate(names)], "id long, type string, surface string").withColumn("norm", X.normalize("surface"))
    side = materialize(resolve.with_overrides(records, spark.createDataFrame([("Birch Hill", "Birch Hill", False)], "a string, b string, same boolean")))
    for most in (400, 100, 8):
        found = lambda equal: resolve.candidate_pairs(side, ["norm", "surface", "ours", "theirs"], most, equal).withColumn("rule", resolve.rule("a", "b", resolve.overridden("a", "b"), F.lit(1.0), F.array().cast("array<string>"))).filter("rule is not null").select("i", "j")  # noqa: B023, E731
        classes = lambda m: {tuple(r) for r in connected_components(m.select(F.col("i").alias("u"), F.col("j").alias("v"))).collect()}
        every, links = found(True), found(False).unionByName(resolve.equals(side, most))
        assert classes(links) == classes(every)
        assert most < 400 or every.count() > 4950 and resolve.equals(side, most).count() == 100 + 1 + 8


def test_declared_aliases_start_no_python(spark, sf_dir):
    plan = store_queries.query.queries["declared_aliases"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan


@pytest.mark.parametrize("tasks,small", [(None, ()), (3, ("R",))])
def test_strongest_walks_are_those_of_all_walks(spark, tasks, small):
    """Whatever ties there are and however often an edge is listed; tails of first nodes that can't be among the strongest are not met."""
    chance = random.Random(5)
    rows = [(f"{a}{chance.randrange(n)}", p, f"{b}{chance.randrange(m)}", chance.choice([1, 1, 1, 2, None])) for p, a, n, b, m in (("P", "a", 4, "b", 12), ("Q", "b", 12, "c", 12), ("R", "c", 12, "d", 5)) for _ in range(60)]
    walks = {}
    for a, p, b, x in rows:
        for b2, q, c, y in rows:
            for c2, r, d, z in rows if (p, q, b2) == ("P", "Q", b) else ():
                if (r, c2) == ("R", c):
                    s = [v or 1 for v in (x, y, z)]
                    walks.setdefault(a, []).append((-sum(s), b, c, d, min(s)))
    edges = spark.createDataFrame(rows, "subject_id string, predicate string, object_id string, support long")
    for most in (1, 7, 40):
        found = graph.paths(edges, ids(spark, "a0", "a1", "a2"), ["P", "Q", "R"], ["P", "Q", "R"], most, tasks, small)
        got = sorted((r.anchor, r["rank"], -r.total_support, r.node_1, r.node_2, r.node_3) for r in found.collect())
        assert got == [(a, k, *w[:4]) for a in ("a0", "a1", "a2") for k, w in enumerate(sorted(walks[a])[:most], 1)]
        if most == 40:
            assert all(r.min_support in {w[4] for w in walks[r.anchor] if w[:4] == (-r.total_support, r.node_1, r.node_2, r.node_3)} for r in found.collect())


@pytest.mark.parametrize("lines", [500_000, 300])
def test_edges_of_keys_are_those_of_facts(spark, sf_dir, tmp_path, monkeypatch, lines):
    """Also where keys are null and lines come twice; with more lines than a task groups, tasks grow with them."""
    for name in ("lineitem", "orders", "supplier", "part", "customer", "nation"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "lineitem":
            odd = F.col("l_orderkey") % 50 == 0
            holes = table.filter(odd).withColumns({"l_linenumber": F.lit(None).cast("int"), "l_partkey": F.when(F.col("l_linenumber") > 2, F.col("l_partkey"))})
            table = table.unionByName(table.filter(odd)).unionByName(holes)
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(tpch_graph, "TASK_LINES", lines)
    told = lambda rows: sorted(map(str, rows.collect()))
    found, want = tpch_graph.edges(spark, str(tmp_path)), graph.collapse(tpch_graph.facts(spark, str(tmp_path)))
    assert found.dtypes == want.dtypes and told(found) == told(want)
    ends = ["subject_id", "predicate", "object_id", "support"]
    assert told(tpch_graph.supports(spark, str(tmp_path), *tpch_graph.NAMES[:6])) == told(want.select(*ends))
    few = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").limit(20)
    some = want.join(few.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("subject_id")), "subject_id", "left_semi").filter("predicate = 'BOUGHT'")
    assert told(tpch_graph.supports(spark, str(tmp_path), "BOUGHT", buyers=few)) == told(some.select(*ends))
    assert lines == 500_000 or tpch_graph.edges(spark, str(tmp_path), "SUPPLIES").rdd.getNumPartitions() == max(8, -(-spark.read.parquet(f"{tmp_path}/lineitem.parquet").count() // lines))


@pytest.mark.parametrize("lead", [64, 1])
def test_questions_are_from_the_first_named_edges(spark, monkeypatch, lead):
    """Also where the first edges have no names, a name is listed twice or a relation has two templates; edges go to no join's shuffle while enough of the first have names."""
    monkeypatch.setattr(questions, "LEAD", lead)
    rows = [edge(f"s{i:03}", p, f"o{i % 7}", *map(str, range(n))) for p in ("P", "Q") for i, n in enumerate([9, 8, 8, 8, 7] + [1] * 200)]
    names = spark.createDataFrame([*((f"s{i:03}", f"S{i}") for i in range(205) if i not in (0, 1)), ("s002", "S2"), *((f"o{i}", f"O{i}") for i in range(7))], "id string, name string")
    templates = spark.createDataFrame([("P", "{subject}?", None), ("Q", "{object}?", None), ("Q", "{subject}, {object}?", "object")], "predicate string, template string, side string")
    made = []
    monkeypatch.setattr(questions, "materialize", lambda df, name, light: made.append(materialize(df, name, light=light)) or made[-1])
    mined = questions.one_hop(spark.createDataFrame(rows, EDGE), names, templates, 3, [F.desc("support")])
    found = sorted(r.question for r in mined.collect())
    assert [q for q in found if q.startswith("S") and "," not in q] == ["S2?", "S2?", "S3?"] and len(found) == 6 and set(found) <= {"S2?", "S3?", "O2?", "S2, O2?"}
    assert [t.count() for t in made] == ([2 * 192, 2 * 191] if lead == 64 else [2 * 3, 2 * 2])
