"""The vector index on disk, full-text search, pairs and counts at hubs."""

import math
import random
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ann_index, graph, routing, vector
from quillgraph.operators.fulltext import B, K1, Inverted


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + n, None if r is None else [float(x) for x in r]) for n, r in enumerate(rows)], "id long, embedding array<float>")


def test_matrix():
    import pyarrow as pa

    rows = pa.array([[1.0, 2, 3], None, [4.0], [], [5.0, 6, 7, 8]], pa.list_(pa.float32()))
    assert vector.matrix(rows, 3).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0], [0, 0, 0], [5, 6, 7]]
    assert vector.matrix(rows.slice(2, 1), 2).tolist() == [[4, 0]] and vector.matrix(rows.slice(0, 0), 2).shape == (0, 2)
    assert vector.matrix(pa.array([[1.0, 2, 3], [4.0, 5, 6]], pa.list_(pa.float64())), 2).tolist() == [[1, 2], [4, 5]]


def test_searches_hold_few_similarities(spark):
    """What a task holds at once doesn't grow with the rows of a batch."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    q, rows = vector.unit(rng.normal(size=(2000, 8))), rng.normal(size=(20_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(list(rows))], ["id", "embedding"])
    cells = vector.Cells(rows[:500], 8, 2)

    class Corpus:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            tracemalloc.start()
            found = list(run(iter([batch])))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return found[0], peak

    far = -np.round(q @ vector.unit(rows).T, 6)
    want = {(n, int(i)) for n in range(len(q)) for i in np.lexsort((np.arange(len(rows)), far[n]))[:3]}
    for probed in ((), (cells, 8)):
        found, peak = vector._top(spark, Corpus(), np.arange(len(q)), q, 3, 8, False, *probed)
        assert set(zip(found["query_id"].to_pylist(), found["id"].to_pylist())) == want
        assert peak < 200e6  # all similarities are 320 MB


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def test_index_finds_neighbours(spark, vectors, tmp_path):
    index = ann_index.Index.build(vectors, str(tmp_path / "i"), 64)
    n = vectors.filter("embedding is not null").count()
    assert index.cells == round(n**0.5) and index.rows().count() == n
    r = ann_index.report(index, vectors, vectors.filter("id % 20 = 0"), 10).first()
    assert r.recall >= 0.9 and r.vectors_read < 0.1 and 0 < r.codes_read <= 1
    asked = vectors.filter("id % 20 = 0")
    got = {(x.query_id, x.rank): (x.id, x.similarity) for x in index.search(asked, 5, most=n).collect()}
    want = {(x.query_id, x.rank): (x.id, x.similarity) for x in vector.topk(vectors, asked, 5, 64).collect()}
    if index.probes == index.cells:
        assert got == want
    # with all cells and all rows it is the exact search
    assert {(x.query_id, x.rank): (x.id, x.similarity) for x in index.search(asked, 5, probes=index.cells, most=n).collect()} == want


def test_index_outlives_and_grows(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    rows = np.concatenate([c + 0.05 * rng.normal(size=(40, 32)) for c in centres])
    folder = str(tmp_path / "i")
    index = ann_index.Index.build(frame(spark, [*rows, None, np.zeros(32)]), folder, 32)
    assert index.probes < index.cells / 3, "clustered vectors need few cells"
    again = ann_index.Index(spark, folder)
    assert (again.probes, again.rerank, again.cells) == (index.probes, index.rerank, index.cells)
    asked = frame(spark, rows[::100], 100_000)
    rank = lambda i: sorted(map(tuple, i.search(asked, 3).collect()))
    assert rank(again) == rank(index)
    assert ann_index.report(again, frame(spark, rows), frame(spark, rows[::60]), 10).first().codes_read < 0.5
    again.add(frame(spark, rows[::100] * 3, 50_000))
    twins = {(n, i) for n in range(12) for i in (100 * n, 50_000 + n)}
    found = {(r.query_id - 100_000, r.id) for r in ann_index.Index(spark, folder).search(asked, 2, most=200).collect()}
    assert found == twins, "rows that came later are found beside the first ones"
    assert len(twins & {(r.query_id - 100_000, r.id) for r in again.search(asked, 2).collect()}) >= 0.8 * len(twins)
    assert again.check().count() == 0
    # a lost cell and a changed one are named
    part = again.state["parts"][0]
    cell = again.rows().filter(F.col("part") == part).agg(F.min("cell")).first()[0]
    shutil.rmtree(f"{folder}/{part}/shelf={cell}")
    assert [tuple(r) for r in ann_index.Index(spark, folder).check().collect()] == [(part, cell, "missing")]


def test_sweep(spark, vectors, tmp_path):
    indexes = {w: ann_index.Index.build(vectors, str(tmp_path / str(w)), w) for w in (16, 64)}
    rows = ann_index.sweep(indexes, vectors, vectors.filter("id % 50 = 0"), 5, (1, None), 2).collect()
    assert [(r.width, r.probes) for r in rows] == [(16, 1), (16, indexes[16].probes), (64, 1), (64, indexes[64].probes)]
    assert all(0 < r.median_ms and 0 < r.p95_ms for r in rows) and rows[3].recall >= 0.9 and rows[0].recall < rows[1].recall


def test_index_of_nothing(spark, tmp_path):
    empty = frame(spark, [])
    index = ann_index.Index.build(empty, str(tmp_path / "e"), 8)
    assert index.search(frame(spark, [np.ones(8)]), 3).count() == 0 and index.check().count() == 0
    with pytest.raises(FileNotFoundError):
        ann_index.Index(spark, str(tmp_path / "nowhere"))
    few = ann_index.Index.build(frame(spark, [np.ones(8), -np.ones(8)]), str(tmp_path / "f"), 8)
    assert [r.id for r in few.search(frame(spark, [np.ones(8)], 9), 1).collect()] == [0]


def test_many_cells_are_reached_by_hubs():
    rng = np.random.default_rng(0)
    model = ann_index.Model(vector.unit(rng.normal(size=(1500, 16))), [])
    assert len(model.hubs) == 39 and sorted(np.concatenate(model.members).tolist()) == list(range(1500))
    rows = vector.unit(rng.normal(size=(50, 16)))
    near, all_of = model.cells(rows, 20), np.argsort(-(rows @ model.centres.T), axis=1)[:, :20]
    assert near.shape == (50, 20) and np.mean([len(set(a) & set(b)) / 20 for a, b in zip(near, all_of)]) > 0.4
    assert (np.sort(model.cells(rows, 1500), axis=1) == np.arange(1500)).all()


def brute_bm25(texts, asked):
    texts = [(i, w) for i, w in texts if w and i is not None]
    n, average = len(texts), sum(len(w) for _, w in texts) / max(1, len(texts))
    df = Counter(w for _, words in texts for w in set(words))
    out = {}
    for q, words in asked:
        best = None
        for i, own in texts:
            tf = Counter(own)
            shared = [w for w in dict.fromkeys(words or []) if w in tf]
            if shared:
                score = sum(round(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (K1 + 1) / (tf[w] + K1 * (1 - B + B * len(own) / average)), 9) for w in shared)
                best = min(x for x in (best, (-round(score, 9), len(own), i)) if x)
        if best:
            out[q] = (best[2], round(-best[0], 6))
    return out


def test_full_text_is_the_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(300)]
    pick = lambda: words[min(rng.randrange(300), rng.randrange(300), rng.randrange(300))]
    texts = [(n, [pick() for _ in range(rng.randrange(1, 9))] + (["the"] if n % 3 else ["the", "the"])) for n in range(900)] + [(None, ["w1"]), (1000, []), (1001, None), (1002, ["the"]), (1003, ["twin", "x"]), (1004, ["twin", "x"])]
    asked = [(n, [pick() for _ in range(rng.randrange(1, 6))] + (["the"] if n % 2 else [])) for n in range(150)] + [(500, ["the"]), (501, ["unheard"]), (502, []), (503, None), (504, ["twin", "the", "twin"]), (505, ["the", "w0", "w1"])]
    index = Inverted.build(spark.createDataFrame(texts, "id long, words array<string>"), str(tmp_path / "t"))
    found = {r.q: (r.id, round(r.score, 6)) for r in index.best(spark.createDataFrame(asked, "q long, words array<string>")).collect()}
    assert found == brute_bm25(texts, asked)
    again = Inverted(spark, str(tmp_path / "t"))
    assert {r.q: r.id for r in again.best(spark.createDataFrame(asked[-2:], "q long, words array<string>")).collect()} == {q: found[q][0] for q, _ in asked[-2:]}


def test_common_words_do_not_fan_out(spark, tmp_path):
    """A word that all texts have is met at its heaviest level alone, or not at all."""
    n = 4000
    texts = spark.range(n).select("id", F.concat(F.array(F.lit("inc")), F.transform(F.sequence(F.lit(1), F.lit(1) + F.col("id") % 9), lambda k: F.concat(F.lit("w"), (F.col("id") * 7 + k).cast("string")))).alias("words"))
    index = Inverted.build(texts, str(tmp_path / "t"))
    asked = spark.createDataFrame([(1, ["inc", "w701"]), (2, ["inc", "w33"])], "q long, words array<string>")
    met = []
    own = Inverted._scores
    index._scores = lambda pairs, words, lists: met.append(pairs.count()) or own(index, pairs, words, lists)
    best = index.best(asked)
    assert met[-1] < n / 50, "texts that only share the common word aren't compared"
    assert {r.q: r.id for r in best.collect()} == {q: i for q, (i, _) in brute_bm25([(r.id, r.words) for r in texts.collect()], [(1, ["inc", "w701"]), (2, ["inc", "w33"])]).items()}


def test_same_texts_and_questions_are_met_once(spark, tmp_path):
    """Copies of a text have one entry a word but all count, and copies of a question don't meet the texts again."""
    kinds = [["inc", "a", "b"], ["b", "inc", "a"], ["inc", "c"], ["inc", "a", "a"], ["rare"]]
    texts = [(n, kinds[n % 4]) for n in range(7, 600)] + [(3, kinds[4])]
    asked = [(n, [["inc", "a"], ["a", "inc", "a"], ["c"], ["rare", "b"], ["none"]][n % 5]) for n in range(100)]
    index = Inverted.build(spark.createDataFrame(texts, "id long, words array<string>"), str(tmp_path / "t"))
    assert index.postings.count() == 8
    met, own = [], Inverted._scores
    index._scores = lambda pairs, words, lists: met.append(pairs.count()) or own(index, pairs, words, lists)
    found = {r.q: (r.id, round(r.score, 6)) for r in index.best(spark.createDataFrame(asked, "q long, words array<string>")).collect()}
    assert found == brute_bm25(texts, asked) and max(met) <= 12


def test_names_by_full_text(spark):
    """A rare word outweighs two common ones, which a count of shared words has the other way round."""
    names = [(str(n), f"Pacific Holding {chr(97 + n % 26)}{chr(97 + n // 26)}x", [], 1) for n in range(60)] + [("rare", "Zanzibar Mining", ["ZM"], 1), ("both", "Pacific Holding Mining", [], 1)]
    index = routing.alias_index(spark.createDataFrame(names, "canonical_id string, name string, aliases array<string>, mention_count long"))
    asked = spark.createDataFrame([("pacific holding of zanzibar",), ("ZM",), ("Zanzibar (Mining) + co",), ("",), (None,)], "surface string")
    assert {r.surface: r.canonical_id for r in routing.resolve_names(asked, index).collect()} == {"pacific holding of zanzibar": "rare", "ZM": "rare", "Zanzibar (Mining) + co": "rare", "": None, None: None}


def brute_shared(links, most, examples=3):
    by = defaultdict(set)
    for s, o in links:
        by[s].add(o)
    n = defaultdict(list)
    for s in sorted(by):
        own = sorted(by[s])
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                n[a, b].append(s)
    ranked = sorted(n.items(), key=lambda x: (-len(x[1]), x[0]))[:most]
    return {(a, b): (len(s), s[:examples]) for (a, b), s in ranked}


def edges_of(spark, links):
    return spark.createDataFrame([(s, "R", o) for s, o in links], "subject_id long, predicate string, object_id long")


@pytest.mark.parametrize("seed,most", [(1, 1), (2, 5), (3, 40), (4, 2000), (5, 5)])
def test_shared_neighbours_are_the_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(graph, "BLOCK", 4)
    rng = random.Random(seed)
    links = [(rng.randrange(25), min(rng.randrange(60), rng.randrange(60))) for _ in range(rng.choice((60, 300, 600)))]
    links += [(99, o) for o in range(200, 260)] + ([(98, o) for o in range(200, 260)] if seed == 5 else [])
    got = {(r.a, r.b): (r.n, r.examples) for r in graph.shared_neighbour(edges_of(spark, links + links[:20]), "R", ["R"], most).collect()}
    assert got == brute_shared(links, most)


def test_hub_of_100000_objects(spark):
    """Its five thousand million pairs aren't made: most of its objects have no other subject."""
    hub = spark.range(100_000).select(F.lit(-1).cast("long").alias("subject_id"), F.lit("R").alias("predicate"), F.col("id").alias("object_id"))
    rest = spark.range(3000).select((F.col("id") % 40).alias("subject_id"), F.lit("R").alias("predicate"), (F.col("id") * 7 % 500).alias("object_id"))
    got = [(r.n, r.a, r.b) for r in graph.shared_neighbour(hub.unionByName(rest), "R", ["R"], 10).orderBy(F.desc("n"), "a", "b").collect()]
    by = defaultdict(set)
    for k in range(3000):
        by[k * 7 % 500].add(k % 40)
    want = sorted((-1 - len(by[a] & by[b]), a, b) for a in range(500) for b in range(a + 1, 500))[:10]
    assert got == [(-n, a, b) for n, a, b in want]
    alone = [(r.n, r.a, r.b) for r in graph.shared_neighbour(hub, "R", ["R"], 3).orderBy("a", "b").collect()]
    assert alone == [(1, 0, 1), (1, 0, 2), (1, 0, 3)]


def test_counts_at_a_hub(spark):
    """No row holds a hub's names; evidence is capped where that is asked for."""
    n = 20_000
    edges = spark.range(n).select(F.lit(-1).cast("long").alias("subject_id"), F.lit("R").alias("predicate"), F.col("id").alias("object_id"), F.array(F.lpad(F.col("id").cast("string"), 6, "0")).alias("chunk_ids"))
    nodes = spark.range(n).select("id", F.concat(F.lit("name "), F.lpad((F.col("id") % 15_000).cast("string"), 6, "0")).alias("name"))
    r = graph.neighbourhood_counts(edges, spark.createDataFrame([(-1,)], "id long"), nodes, cites=3).first()
    assert (r.n, r.examples, r.chunk_ids) == (15_000, [f"name {k:06d}" for k in range(8)], ["000000", "000001", "000002"])
    plan = graph.neighbourhood_counts(edges, spark.createDataFrame([(-1,)], "id long"), nodes, cites=3)._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("block,busy", [(512, 4096), (4, 4096), (3, 5)])
def test_pairs_are_counted_where_lists_meet(spark, monkeypatch, block, busy):
    """Lists go to their objects' tasks, hubs on either side are dealt over several, and no pair is shuffled."""
    for name, value in (("BLOCK", block), ("BUSY", busy), ("LISTED", 50), ("COUNTED", 50)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(block)
    links = sorted({(rng.randrange(20), min(rng.randrange(50), rng.randrange(50))) for _ in range(400)})
    counted = graph._pair_counts(spark.createDataFrame([(s, o, o % 3 > 0) for s, o in links], "subject_id long, o int, first boolean"))
    assert {(r.a, r.b): r.n for r in counted.collect()} == {k: n for k, (n, _) in brute_shared(links, 10_000).items() if k[0] % 3 > 0}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(a#\d+L?, part#", plan) and not re.search(r"hashpartitioning\([^)]*\bb#", plan)
