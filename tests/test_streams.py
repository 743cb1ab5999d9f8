"""Streams, sources, bucketed tables, calls over tables, the gate and closed schemas."""

import glob
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ann_index, chat, gate, logs, strict
from quillgraph.runtime import shared_dir
from quillgraph.sources.feeds import EventLines, Filings
from quillgraph.sources.manifest import Manifest
from quillgraph.streaming import supersede
from quillgraph.streaming.merge import Bucketed

LOG = "k string, at timestamp, n long, value double, note string"


def test_manifest(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "states"))
    assert m.latest() == (-1, {}) and m.numbers() == []
    m.commit(0, {"a": 1})
    m.commit(10, {"a": "é"})
    m.commit(9, {"a": 3})
    assert m.latest() == (10, {"a": "é"}) and m.numbers() == [0, 9, 10] and m.read(9) == {"a": 3}
    with pytest.raises(FileExistsError):
        m.commit(10, {})
    assert m.read(10) == {"a": "é"} and sorted(x for x in os.listdir(tmp_path / "states") if not x.endswith(".crc")) == ["0.json", "10.json", "9.json"]


def log_rows(seed):
    rng = random.Random(seed)
    from datetime import datetime, timezone

    stamp = lambda s: datetime(2024, 1, 1, 0, 0, s, 123456, tzinfo=timezone.utc) if s is not None else None
    rows = [(f"k{rng.randrange(12)}", stamp(rng.randrange(50)), n, rng.random(), rng.choice([None, "x", "é\n\"q\""])) for n in range(300)]
    return [*rows, ("null", None, 900, 0.9, None), ("null", stamp(1), 901, 0.5, "n"), ("gone", stamp(1), 902, 0.5, "old"), ("gone", stamp(9), 903, 0.01, "evicts")]


@pytest.mark.parametrize("seed", [1, 2])
def test_superseded_is_the_replay(spark, tmp_path, seed):
    """Shuffled micro-batches, and a restart in their midst, give what the batch replay gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", supersede.PROVIDER)
    rows = log_rows(seed)
    random.Random(seed).shuffle(rows)
    whole = spark.createDataFrame(rows, LOG)
    stale = F.col("value") < 0.1
    out = []

    def keep(batch, number):
        out.extend((r.k, r.payload, r.evicted, number) for r in batch.collect())

    for part in range(3):
        spark.createDataFrame(rows[part::3], LOG).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
        log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        query = supersede.superseded(log, ["k"], ["at", "n"], stale, keep=None).writeStream.outputMode("update").foreachBatch(keep)
        query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    changes = spark.createDataFrame(out, "k string, payload string, evicted boolean, number long")
    got = supersede.current(changes, ["k"], "number", whole.schema).select(*whole.columns)
    want = logs.replay(whole, ["k"], ["at", "n"], stale).select(*whole.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "gone" not in {r.k for r in got.collect()}


def test_superseded_changes(spark, tmp_path):
    """A change is one row, an older row none; of equal orders the later arrival counts, and what has no order comes first."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", supersede.PROVIDER)
    kind, out = "k string, at double, note string", []
    batches = [[("a", 2.0, "first"), ("b", float("nan"), "none"), ("c", 5.0, "stays")], [("a", 2.0, "later"), ("b", 0.5, "some"), ("c", 4.0, "old")], [("a", 1.0, "old"), ("b", None, "old"), ("c", 6.0, "x")]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        log = spark.readStream.schema(kind).parquet(str(tmp_path / "in/*"))
        changes = supersede.superseded(log, ["k"], ["at"], F.col("note") == "x")
        query = changes.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((n, r.k, json.loads(r.payload)["note"], r.evicted) for r in b.collect()))
        query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        assert "WithState" not in changes._jdf.queryExecution().analyzed().toString()
    assert sorted(x[1:] for x in out) == sorted([("a", "first", False), ("b", "none", False), ("c", "stays", False), ("a", "later", False), ("b", "some", False), ("c", "x", True)])


def test_bucketed_rewrites_what_a_batch_touches(spark, tmp_path):
    table = Bucketed(spark, str(tmp_path / "t"), "id long, n long", ["id"], 8)
    add = lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))
    rows = spark.range(1000).select("id", F.lit(1).cast("long").alias("n"))
    assert table.read().count() == 0 and table.merge(rows, add, 0)
    before = Manifest(spark, f"{tmp_path}/t/states").latest()[1]["folders"]
    few = spark.createDataFrame([(3, 10), (5000, 7)], "id long, n long")
    assert table.merge(few, add, 1) and not table.merge(few, add, 1) and not table.merge(rows, add, 0)
    after = Manifest(spark, f"{tmp_path}/t/states").latest()[1]["folders"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert 1 <= len(changed) <= 2 and len(set(after.values())) == 2
    written = {f: sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(tmp_path / "t" / f) for x in names) for f in set(after.values())}
    assert min(written.values()) < max(written.values()) / 2, "bytes written follow the batch"
    got = {r.id: r.n for r in Bucketed(spark, str(tmp_path / "t"), "id long, n long", ["id"]).read().collect()}
    assert got == {k: 1 for k in range(1000)} | {3: 11, 5000: 7}

    # a merge that dies leaves the version before; rows may go, too
    def dies(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.merge(few, dies, 2)
    assert {r.id: r.n for r in table.read().collect()} == got
    table.merge(rows, lambda old, new: old.join(new, "id", "left_anti"), 2)
    assert [tuple(r) for r in table.read().collect()] == [(5000, 7)] and table.read(number=1).count() == 1001
    assert table.sweep(keep=1) >= 1 and [tuple(r) for r in table.read().collect()] == [(5000, 7)]


def test_filings(spark, tmp_path):
    listed = lambda *rows: dict(zip(("form", "accessionNumber", "filingDate", "primaryDocument"), map(list, zip(*rows)))) if rows else {}
    (tmp_path / "CIK0000000007.json").write_text(json.dumps({"name": "Ash Inc.", "tickers": ["ASH", "ASHB"], "filings": {"recent": listed(("10-K", "0000000007-24-000001", "2024-02-01", "a.htm"), ("10-K/A", "0000000007-24-000002", "2024-03-01", "b.htm"), ("8-K", "0000000007-24-000003", "2024-01-05", "")), "files": [{"name": "CIK0000000007-submissions-001.json"}]}}))
    (tmp_path / "CIK0000000007-submissions-001.json").write_text(json.dumps(listed(("10-K", "0000000007-20-000009", "2020-02-01", "z.htm"), ("4", "0000000007-20-000010", "2020-02-02", "f.xml"))))
    (tmp_path / "CIK0000000008.json").write_text(json.dumps({"name": "Birch", "tickers": [], "filings": {"recent": {}}}))
    spark.dataSource.register(Filings)
    read = lambda **o: spark.read.format("filings").options(base=f"file://{tmp_path}", ciks="7, 8,9", archive="https://example.org/data", **o).load()
    rows = read(forms="10-K,8-K").collect()
    assert [(r.ticker, r.company, r.cik, r.form, r.accession, str(r.filing_date), r.document) for r in sorted(rows, key=lambda r: r.filing_date)] == [
        ("ASH", "Ash Inc.", "0000000007", "10-K", "0000000007-20-000009", "2020-02-01", "https://example.org/data/7/000000000720000009/z.htm"),
        ("ASH", "Ash Inc.", "0000000007", "8-K", "0000000007-24-000003", "2024-01-05", None),
        ("ASH", "Ash Inc.", "0000000007", "10-K", "0000000007-24-000001", "2024-02-01", "https://example.org/data/7/000000000724000001/a.htm"),
    ]
    assert read().count() == 4 and read(amendments="true").count() == 5 and read().rdd.getNumPartitions() == 3
    from quillgraph.sources import sections

    assert [r.accession for r in sections.newest(read()).filter("form = '10-K'").collect()] == ["0000000007-24-000001"]


def test_event_lines_lose_and_repeat_nothing(spark, tmp_path):
    folder = tmp_path / "sse"
    folder.mkdir()
    spark.dataSource.register(EventLines)

    def run():
        lines = spark.readStream.format("event_lines").option("folder", str(folder)).option("most", 64).load()
        lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.request_id, r.seq, r.line) for r in spark.read.schema("request_id string, seq long, line string").parquet(str(tmp_path / "out")).collect())

    def want(**files):
        out = []
        for name, text in files.items():
            at = 0
            for line in text.encode().split(b"\n")[:-1]:
                out.append((name, at, line.rstrip(b"\r").decode()))
                at += len(line) + 1
        return sorted(out)

    a, b = "".join(f"data: line {n} é\n" for n in range(40)) + "data: half", "x" * 70000 + "\r\n\n" + "y\n"
    (folder / "a.sse").write_bytes(a.encode())
    (folder / "other.txt").write_text("not read\n")
    assert run() == want(a=a)
    with open(folder / "a.sse", "ab") as file:
        file.write(b" a line\nmore")
    (folder / "b.sse").write_bytes(b.encode())
    assert run() == want(a=a + " a line\nmore", b=b)
    assert run() == want(a=a + " a line\nmore", b=b)
    batch = spark.read.format("event_lines").option("folder", str(folder)).option("most", 50).load()
    assert sorted((r.request_id, r.seq, r.line) for r in batch.collect()) == want(a=a + " a line\nmore", b=b)
    assert spark.read.format("event_lines").option("folder", str(tmp_path / "none")).load().count() == 0


def make_call(folder):
    """A call that notes each request in a file, fails at first for some and always for others."""
    os.makedirs(folder, exist_ok=True)

    def call(system, user, schema):
        name = os.path.join(folder, user)
        tries = os.path.getsize(name) if os.path.exists(name) else 0
        with open(name, "a") as file:
            file.write("x")
        if user.startswith("slow") and tries < 2:
            raise chat.Passing("429")
        if user.startswith("bad"):
            raise ValueError("400")
        return ("no JSON" if user.startswith("odd") else json.dumps({"to": user})), 1000, 500

    return call


def test_chat_table(spark, tmp_path):
    asked = str(tmp_path / "asked")
    make = lambda **o: chat.ChatTable(spark, str(tmp_path / "cache"), make_call(asked), o.pop("model", "m"), {"type": "object"}, price=(1.0, 2.0), per_minute=1e9, lanes=3, round_keys=10, sleep=lambda s: None, **o)
    users = [*(f"u{n}" for n in range(25)), *(f"slow{n}" for n in range(3)), "bad0", "odd0"]
    rows = spark.createDataFrame([(n, "s", u, "x") for n, u in enumerate(users * 2)], "id long, system string, user string, key string")
    table = make()
    found = table.replies(rows).collect()
    assert len(found) == 60 and all((r.reply == json.dumps({"to": r.user})) == (r.user[0] in "us") and (r.error is None) == (r.user[0] in "us") and not r.cached and r.key == "x" for r in found)
    size = {u: os.path.getsize(os.path.join(asked, u)) for u in users}
    assert all(n == (3 if u.startswith("slow") else 1) for u, n in size.items()), "one call a key; only what may pass is tried again"
    m = table.meter().first()
    assert (m.calls, m.failed, m.tokens_in, m.tokens_out) == (30, 2, 29_000, 14_500) and m.usd == pytest.approx(29_000e-6 + 2 * 14_500e-6)
    # a second run, of another session's table, calls nothing but what failed
    again = make().replies(rows.filter("user not like 'bad%' and user not like 'odd%'")).collect()
    assert all(r.cached and r.error is None for r in again) and {u: os.path.getsize(os.path.join(asked, u)) for u in users} == size
    # an option that is set is another key, one that isn't is none
    assert make(effort=None).replies(rows.limit(1)).first().cached and not make(effort="low").replies(rows.limit(1)).first().cached
    assert not make(model="other").replies(rows.limit(1)).first().cached
    empty = make().replies(rows.limit(0))
    assert empty.count() == 0


def test_budget_stops_calls(spark, tmp_path):
    table = chat.ChatTable(spark, str(tmp_path / "cache"), make_call(str(tmp_path / "asked")), "m", {}, price=(1.0, 2.0), per_minute=1e9, lanes=2, round_keys=20)
    rows = spark.createDataFrame([("s", f"u{n}") for n in range(100)] + [(None, None)], "system string, user string").filter("user is not null")
    found = table.replies(rows, budget=0.02).collect()  # ten calls
    asked = [r for r in found if r.reply]
    assert 10 <= len(asked) <= 12 and {r.error for r in found if not r.reply} == {"over_budget"} and len(found) == 100
    assert table.meter().first().calls == len(asked)
    assert all(r.reply for r in table.replies(rows).collect()) and table.meter().first().calls == 100


def stores(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "R", "b", ["1", "2"]), ("b", "S", "c", ["3"])], "subject_id string, predicate string, object_id string, chunk_ids array<string>")
    passages = spark.createDataFrame([("1", ["a", "b", "c"], [1.0]), ("2", ["a"], [1.0]), ("3", [], [1.0])], "chunk_id string, entity_ids array<string>, embedding array<double>")
    return {"nodes": nodes, "edges": edges, "passages": passages, "chunks": passages.select("chunk_id")}


GATE = {"relations": (("R", "X", "X"), ("S", "X", "X")), "orphans": 0.3}


def test_gate_names_each_breach(spark, tmp_path):
    good = stores(spark)
    figures, failures = gate.verify(**good, **GATE)
    assert failures == [] and figures == {"nodes": 3, "edges": 2, "loops": 0, "orphans": 0, "passages": 3, "chunks": 3, "looked_up": 1, "joined": 1, "without embedding": 0, "edges of R": 1, "edges of S": 1}
    edges = good["edges"]
    breaches = {
        "orphans: 2 of 5 nodes, more than 30%": {"nodes": good["nodes"].unionByName(spark.createDataFrame([("x",), ("y",)], "id string"))},
        "loops: 1": {"edges": edges.unionByName(spark.createDataFrame([("a", "R", "a", [])], edges.schema))},
        "empty relation: S": {"edges": edges.filter("predicate = 'R'"), "nodes": good["nodes"].filter("id <> 'c'")},
        "unknown relation: 1 edges": {"edges": edges.unionByName(spark.createDataFrame([("a", "T", "b", [])], edges.schema))},
        "incomplete: 1 passages without embedding": {"passages": good["passages"].withColumn("embedding", F.when(F.col("chunk_id") > "1", F.col("embedding")))},
        "parity: 3 passages, 2 chunks": {"chunks": good["chunks"].filter("chunk_id < '3'")},
        "join key: no edge cites any of 1 passages": {"edges": edges.withColumn("chunk_ids", F.array(F.lit("9")))},
        "index i: it isn't there": {"indexes": {"i": None}},
    }
    for breach, changed in breaches.items():
        assert gate.verify(**(good | changed), **GATE)[1] == [breach]
    index = ann_index.Index.build(spark.createDataFrame([(n, [float(n % 3), 1.0, float(n % 5)]) for n in range(60)], "id long, embedding array<float>"), str(tmp_path / "i"), 3)
    assert gate.verify(**good, **GATE, indexes={"i": index})[1] == []
    part, cell = index.state["parts"][0], index.rows().agg(F.max("cell")).first()[0]
    shutil.rmtree(f"{tmp_path}/i/{part}/shelf={cell}")
    assert gate.verify(**good, **GATE, indexes={"i": ann_index.Index(spark, str(tmp_path / "i"))})[1] == [f"index i: cell {cell} missing"]
    none = {k: v.limit(0) for k, v in good.items()}
    assert gate.verify(**none, **GATE)[1] == ["empty relation: R", "empty relation: S"]


def test_gate_writes_only_the_evidence_looked_up(spark):
    """Passages of one id count each; ids that no lookup asks for aren't written, however many edges cite them."""
    good, old = stores(spark), set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/gate-*"))
    edges = spark.createDataFrame([("a", "R", "b", ["1", *map(str, range(10, 500))]), ("b", "S", "c", ["3"])], good["edges"].schema)
    passages = good["passages"].unionByName(good["passages"].filter("chunk_id = '1'"))
    figures, _ = gate.verify(**(good | {"edges": edges, "passages": passages}), **GATE)
    assert (figures["looked_up"], figures["joined"], figures["edges"]) == (2, 2, 2)
    (path,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/gate-*")) - old
    assert [(r.id, r.kind) for r in spark.read.schema("id string, kind string").parquet(path).filter("kind = 'chunk'").collect()] == [("1", "chunk")]


SCHEMA = {
    "type": "object",
    "$defs": {"Place": {"type": "object", "properties": {"x": {"type": "number"}}, "required": ["x"]}},
    "properties": {"a": {"type": "string"}, "n": {"type": "integer"}, "on": {"type": "boolean"}, "at": {"type": "array", "items": {"$ref": "#/$defs/Place"}}, "kind": {"enum": ["p", "q"]}},
    "required": ["a", "at"],
}


@pytest.mark.parametrize(
    "reply,want",
    [
        ('{"a": "x", "at": []}', []),
        (' {"a": "x", "n": -3, "on": true, "at": [{"x": 1.5}, {"x": 2}], "kind": "q"}', []),
        ('{"a": "x", "at": [{"x": 1, "y": 2}, {}]}', ["$.at[].x: missing", "$.at[].y: not in the schema"]),
        ('{"a": null, "at": {}, "b": 1}', ["$.a: missing", "$.at: not an array", "$.b: not in the schema"]),
        ('{"a": "x", "at": [1, null], "n": 1.5, "on": "yes", "kind": "r"}', ["$.at[]: missing", "$.at[]: not an object", "$.kind: not one of the values: r", "$.n: not an integer", "$.on: not a boolean"]),
        ("[1]", ["$: not JSON"]),
        ("no JSON", ["$: not JSON"]),
        ("", ["$: not JSON"]),
        (None, ["$: not JSON"]),
    ],
)
def test_closed_schema(spark, reply, want):
    assert strict.closed(SCHEMA)["$defs"]["Place"]["additionalProperties"] is False and "additionalProperties" not in SCHEMA
    rows = spark.createDataFrame([(1, reply)], "id long, reply string")
    good, bad = strict.quarantined(rows, "reply", SCHEMA, "a string, n long, on boolean, at array<struct<x: double>>, kind string")
    assert (good.count(), bad.count()) == ((1, 0) if not want else (0, 1))
    assert sorted(bad.first().problems if want else []) == want
    if not want:
        assert good.first().parsed.a == "x"
