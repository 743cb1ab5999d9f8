import pytest
from pyspark.sql import functions as F

from quillgraph.operators import reports
from quillgraph.schemas import DEFINITIONS, ENTITY_TYPES, RELATIONS


def test_vocabulary_block():
    lines = reports.vocabulary_block().split("\n")
    assert [x for x in lines if x.startswith("- ")] == [f"- {name} ({subject} -> {object_}): {DEFINITIONS[name]}" for name, subject, object_, *_ in RELATIONS]
    assert len(RELATIONS) == len(DEFINITIONS) == 14 and all(DEFINITIONS.values())
    assert lines[1] == "Relations:" and lines[0].count(",") == len(ENTITY_TYPES) - 1 and lines[-1].startswith("Risk topics: ")


def test_evidence_keeps_whole_passages(spark):
    q = spark.createDataFrame([("q1", ["2", "1", "3"], ["Ash"], 4), ("q2", [], [], None)], "qid string, gold_chunk_ids array<string>, expected_answers array<string>, expected_count long")
    p = spark.createDataFrame([("1", "a" * 30), ("2", "b" * 30), ("3", "c" * 100)], "chunk_id string, text string")
    found = {r.qid: r.reference for r in reports.evidence(q, p, chars=80).collect()}
    assert found["q1"] == "Exact count: 4\n\nKnown answers: Ash\n\n[1]\n" + "a" * 30 + "\n\n[2]\n" + "b" * 30 + "\n\nPassages left out: 1"
    assert found["q2"] == ""
    assert "left out: 2" in {r.qid: r.reference for r in reports.evidence(q, p, most=1).collect()}["q1"]


def test_completeness(spark):
    q, log = spark.createDataFrame([("a",), ("b",)], "qid string"), spark.createDataFrame([("a", 1)], "qid string, x long")
    with pytest.raises(ValueError, match="b"):
        reports.complete(q, log)
    assert reports.complete(q.filter("qid = 'a'"), log).count() == 1


def test_agreement_and_misses(spark):
    rows = [("a", 1.0, "correct"), ("b", 0.0, "correct"), ("c", 1.0, "partial"), ("d", None, "incorrect")]
    s = spark.createDataFrame(rows, "qid string, key double, verdict string").withColumns({"question": F.lit("?"), "reason": F.lit("x" * 99)})
    r = reports.agreement(s).first()
    assert (r.keyed, r.agree, r.rescued, r.overridden) == (3, 1, ["b"], ["c"])
    assert sorted(x.qid for x in reports.misses(s).collect()) == ["c", "d"] and len(reports.misses(s).first().reason) == 80


def test_costs(spark):
    a = spark.createDataFrame([(0.2, 10.0, True), (0.4, 30.0, True), (0.0, 1.0, True), (0.0, 1.0, False)], "usd double, latency_ms double, answerable boolean")
    r = reports.billed(a).first()
    assert (r.billed, r.cached, r.free_refusals, r.median_ms, r.mean_usd) == (2, 1, 1, 20.0, 0.3)
    assert reports.projected_usd(0.3, 15, 150) == pytest.approx(3.0) and reports.projected_usd(0, 0, 9) == 0
    assert reports.embedding_usd(spark.createDataFrame([("x" * 40,), (None,)], "t string"), "t", 1e5) == pytest.approx(1.0)


def test_refusals_and_kinds(spark):
    a = spark.createDataFrame([(["all", "hand"], False, True), (["all"], True, False)], "strata array<string>, answerable boolean, fallback boolean")
    assert {r.stratum: (r.refused, r.fallbacks) for r in reports.refusals(a).collect()} == {"all": (1, 1), "hand": (1, 1)}
    assert reports.by_kind(a, F.col("answerable").cast("string")).count() == 2
    text = a.limit(1).select(reports.chunk_prompt(F.lit("C"), F.lit("S"), F.lit("2024-01-01"), F.lit("body")).alias("p")).first().p
    assert text == "Filer: C\nSection: S\nFiled: 2024-01-01\n\nbody"
