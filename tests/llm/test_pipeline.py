import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import brute_exact
from tests.llm.test_models import brute_quality
from tests.llm.test_models import words as brute_words
from tests.llm.test_shingle_join import brute_jaccard
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        out.append((name, before, docs.collect(), docs))
    return {name: (before, after, frame) for name, before, after, frame in out}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "exact_dedup", "simhash_near_dedup", "packing"]


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name][2].columns == list(corpus_pipeline.COLUMNS)


def test_quality_takes_effect(stages):
    before, after, _ = stages["quality_rules"]
    kept = {r.doc_id for r in after}
    assert kept <= {r.doc_id for r in before if not brute_quality(r.text)[5]}
    assert len(kept) > 0.7 * len(before)


def test_language_keeps_prose(stages):
    before, after, _ = stages["language_id"]
    assert len(after) >= 0.98 * len(before)


def test_exact_takes_effect(stages):
    before, after, _ = stages["exact_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(x[0] for x in brute_exact([(r.doc_id, r.text) for r in before]) if x[3])


def test_near_takes_effect(stages):
    """Similarity 0.8 or more over shingles of five words, against all pairs."""
    before, after, _ = stages["simhash_near_dedup"]
    items = [(r.doc_id, r.text) for r in before]
    assert sorted(r.doc_id for r in after) == sorted(i for (i, _), c in zip(items, brute_jaccard(items)) if i == c)


SHARED = [
    (4, "r unique words that no other row of this table has in it at all, not one"), (1, "x  y and some more words that follow so that it is long enough to be kept"),
    (4, "x y and some more words that follow so that it is long enough to be kept"), (None, "x y and some more words that follow so that it is long enough to be kept"),
    (None, "another unique text whose row has no id and which must stay, as it is clean"), (None, "another unique text whose row has no id and which must stay, as it is clean"),
    (8, "short"), (None, "short"), (8, "a clean text that shares its id with a short one, which must go alone then"), (None, None),
]


def test_rows_are_told_apart_without_ids(spark, sf_dir):
    """Rows that share an id or have none: each stage decides on each row."""
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in SHARED], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = sf_dir
    docs = corpus_pipeline.materialize(corpus_pipeline.quality_stage(spark, docs, labels))
    assert sorted(str((r.doc_id, r.text)) for r in docs.collect()) == sorted(str(x) for x in SHARED if len(brute_words(x[1])) >= 10)
    docs = corpus_pipeline.materialize(corpus_pipeline.language_stage(spark, docs, labels))
    assert docs.count() == 7
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        left = stage(spark, docs, labels).collect()
        assert sorted(str((r.doc_id, " ".join(r.text.split()))[:2]) for r in left) == sorted(str((i, " ".join(t.split()))) for i, t in (SHARED[0], SHARED[1], SHARED[4], SHARED[8]))


def test_packing_holds_all(stages, spark, sf_dir):
    before, after, _ = stages["packing"]
    frame = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    assert check_packing(frame, after, 2048) < 0.02
    whole = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("held")).collect()
    assert sorted((r.doc_id, r.held) for r in whole) == sorted((r.doc_id, r.n) for r in whole) == sorted({(r.doc_id, r.doc_tokens) for r in after})


def test_odd_rows_go_through(odd_docs, spark, sf_dir):
    """Each stage's rows by brute force; in the end the pieces of all that is left."""
    docs, left = odd_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        after = docs.collect()
        left[name] = sorted(str(r.doc_id) for r in after)
        if name == "quality_rules":
            passed = [r for r in before if not brute_quality(r.text)[5]]
            assert set(left[name]) <= {str(r.doc_id) for r in passed}
        elif name == "exact_dedup":
            assert len(after) == len({"".join((r.text or "").split()) for r in before})
        elif name == "simhash_near_dedup":
            assert len(after) == len({c if c is not None else ("none", k) for k, c in enumerate(brute_jaccard([(r.doc_id, r.text) for r in before]))})
        elif name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())
    docs = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
    assert docs.count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u3000"])
def test_very_long_blanks_go_through(spark, sf_dir, blank):
    """Prose around a million blanks passes every stage and is packed whole."""
    prose = " ".join(f"word{k} and a sentence that says little but says it at some length." for k in range(60))
    docs = spark.createDataFrame([(1, prose + blank * 1_000_000 + "end", "en", "s", 1), (2, "Another " + prose[::-1] + " text.", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[2:]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
    pieces = docs.collect()
    for doc in (1, 2):
        assert sum(r.length for r in pieces if r.doc_id == doc) == max(r.doc_tokens for r in pieces if r.doc_id == doc)
