"""Line dedup against a plain version; runs that outlive a job."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import line_dedup
from quillgraph.llm.line_dedup import LineRuns, dedup_lines
from quillgraph.sources.manifest import Manifest

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANK))


def plain_version(rows):
    """rows (doc_id, text) with n_lines, n_dropped, text."""
    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            held = first.setdefault(k, doc_id)
            first[k] = held if doc_id is None else doc_id if held is None else min(held, doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= 10 and first[k] is not None and (doc_id is None or first[k] < doc_id) for x in lines]
        out.append((str(doc_id), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    lines = ["Subscribe to our newsletter", "\tsubscribe TO our newsletter ", "short", "", "   ", "ÀÉÎ are not lowered", "àéî are not lowered", "ten chars!", "nine char", *(f"line that few documents have, number {k}" for k in range(60)), "inner    blanks   stay apart", "inner blanks stay apart"]
    made = [(rng.randrange(40), "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 12)))) for _ in range(120)]
    return [*made, *made[:3], (None, "Subscribe to our newsletter\nonly rows without an id have this"), (None, "only rows without an id have this\nline that few documents have, number 3"), (7, None), (8, ""), (9, "\n\n"), (10, "x" * 300000 + "\nSubscribe to our newsletter"), (50, " " * 200000 + "y\n" + "y" + " " * 200000)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 2), (5, 3)])
def test_is_the_plain_version(spark, rows, batches, fanout):
    docs = spark.createDataFrame([(i, t, "h", 1, 2) for i, t in rows], "doc_id long, text string, h string, pos int, r1 int").repartition(3)
    assert found(dedup_lines(docs, batches=batches, fanout=fanout)) == plain_version(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(dedup_lines(odd_docs)) == plain_version(rows)
    assert dedup_lines(no_docs).count() == 0


def test_native(spark, sf_docs):
    plan = dedup_lines(sf_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_outlive_the_job(spark, rows, tmp_path):
    """Crawl after crawl: lines that an earlier one had go; a second try of one changes nothing; runs stay few."""
    crawls = [rows[k::4] for k in range(4)]
    seen: set[str] = set()
    for n, part in enumerate(crawls):
        docs = spark.createDataFrame(part, "doc_id long, text string")
        runs = LineRuns(spark, str(tmp_path / "runs"), buckets=5)
        got = found(dedup_lines(docs, batches=2, runs=runs, name=f"crawl {n}"))
        want = []
        for doc_id, _, _, text in plain_version(part):
            kept = [x for x in text.split("\n") if not (len(key(x)) >= 10 and key(x) in seen)] if text else [""]
            want.append((doc_id, "\n".join(kept)))
        assert sorted((i, t) for i, _, _, t in got) == sorted(want)
        state = Manifest(spark, str(tmp_path / "runs/states")).latest()
        again = LineRuns(spark, str(tmp_path / "runs"))
        assert again.buckets == 5 and found(dedup_lines(docs, batches=2, runs=again, name=f"crawl {n}")) == got
        assert Manifest(spark, str(tmp_path / "runs/states")).latest() == state
        seen |= {key(x) for _, t in part for x in (t or "").split("\n")}
    assert len(runs.runs) <= 2 * 4 and max(r["level"] for r in runs.runs) >= 2
    keys = [(r.h, r.g) for x in runs.runs for r in runs._table(x["path"]).filter("not seen").collect()]
    assert len(keys) == len(set(keys)) == len({k for k in seen if len(k) >= 10})


def test_runs_are_merged_without_a_shuffle(spark, rows, tmp_path):
    lines = line_dedup._lines(line_dedup._texts(spark.createDataFrame(rows, "doc_id long, text string")), 10)
    runs = LineRuns(spark, str(tmp_path / "runs"), fanout=9)
    runs.add(lines.filter("doc_id < 20"), "a")
    run = runs._table(runs.runs[0]["path"]).filter("not seen").select("h", "g", F.lit(True).alias("in_0"))
    joined = lines.filter("doc_id >= 20").groupBy("h", "g").agg(F.min("doc_id").alias("first")).join(run.hint("merge"), ["h", "g"], "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
