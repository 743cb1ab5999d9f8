"""All stages over some filings, offline: from sections to cited answers, over the command line and the service."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from quillgraph import cli
from quillgraph.operators import models
from quillgraph.stages import Models, Workspace

FILLER = "The company describes its business, its customers and the markets that it serves at some length in this section. " * 4


def text_of(company, sentences):
    return FILLER + " ".join(sentences) + f" {company} files this report."


FILED = [
    ("ASH", "Ash Corp", 1, "10-K", "a-1", "2024-02-01", {"Item 1": text_of("Ash Corp", ["Birch Inc supplies wafers to Ash Corp.", "Ash Corp competes with Cedar Corp."]), "Item 9": "not read"}, []),
    ("ASH", "Ash Corp", 1, "10-K", "a-0", "2020-02-01", {"Item 1": text_of("Ash Corp", ["Old Corp supplies wafers to Ash Corp."])}, []),
    ("CED", "Cedar Corp", 3, "10-K", "c-1", "2024-02-01", {"Item 1": text_of("Cedar Corp", ["Birch Inc. supplies wafers to Cedar Corp.", "Broken reply here."]), "Item 7": "short"}, []),
]


def extract(system, user, schema):
    """Finds what the sentences say; one chunk's first reply has a key too many, one relation is not in the text."""
    names = ["Birch Inc", "Birch Inc.", "Ash Corp", "Cedar Corp"]
    held = [n for n in names if n in user.split("\n\n", 1)[1] and (n != "Birch Inc" or "Birch Inc " in user)]
    relations = []
    for a, verb, b, p in (("Birch Inc", " supplies wafers to ", "Ash Corp", "SUPPLIES"), ("Birch Inc.", " supplies wafers to ", "Cedar Corp", "SUPPLIES"), ("Ash Corp", " competes with ", "Cedar Corp", "COMPETES_WITH")):
        if a + verb + b in user:
            relations.append({"subject": a, "predicate": p, "object": b, "confidence": "high", "evidence": a + verb + b})
    if "Ash Corp files" in user:
        relations.append({"subject": "Ash Corp", "predicate": "ACQUIRED", "object": "Cedar Corp", "confidence": "low", "evidence": "made up"})
    reply = {"mentions": [{"name": n, "type": "Company"} for n in held], "relations": relations}
    if "Broken reply" in user and "was rejected" not in user:
        reply["note"] = "x"
    return json.dumps(reply), 1000, 100


def answer(system, user, schema):
    if system == "plan":
        return json.dumps({"route": "both", "confidence": "high", "entities": ["Birch Inc"], "shape": "one_hop", "chain": ["SUPPLIES"]})
    shown = user.split("[")[1].split("]")[0]
    return json.dumps({"answerable": True, "claims": [{"text": "Birch supplies them.", "citations": [shown.split(",")[0].strip()]}]})


def offline():
    return Models(extract=extract, chat=answer, embed=models.fake_embed, width=models.DIMENSIONS)


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("space")
    with open(root / "filings.json", "w") as file:
        for row in FILED:
            file.write(json.dumps(dict(zip(("ticker", "company", "cik", "form", "accession", "filing_date", "sections", "exhibits"), row))) + "\n")
    args = ["--folder", str(root / "w"), "--models", "tests.test_stages:offline"]
    assert cli.main(["all", *args, "--filings", str(root / "filings.json")], spark) == 0
    return Workspace(spark, str(root / "w"), offline(), say=lambda text: None), args


def test_stages_build_the_graph(space):
    w, _ = space
    assert {r.accession for r in w.chunks.collect()} == {"a-1", "c-1"}
    rows = w.extractions.collect()
    assert len(rows) == w.chunks.count() and {r.attempts for r in rows} == {1, 2} and sum((r.dropped or {}).get("evidence_not_found", 0) for r in rows) >= 1
    names = {r.id: r.name for r in w.nodes.read().collect()}
    assert sorted(names.values()) == ["Ash Corp", "Birch Inc", "Cedar Corp"] or sorted(names.values()) == ["Ash Corp", "Birch Inc.", "Cedar Corp"]
    edges = {(names[r.subject_id][:5], r.predicate, names[r.object_id]) for r in w.edges.read().collect()}
    assert edges == {("Birch", "SUPPLIES", "Ash Corp"), ("Birch", "SUPPLIES", "Cedar Corp"), ("Ash C", "COMPETES_WITH", "Cedar Corp")}
    passages = w.passages.read().collect()
    assert len(passages) == w.chunks.count() and all(p.embedding and p.entity_ids for p in passages)
    assert w.index().rows().count() == len(passages)


def test_stages_again_change_nothing(space, spark):
    w, args = space
    calls, graph = w.calls.meter().first(), sorted(map(str, w.edges.read().collect()))
    for stage in ("extract", "resolve", "load", "embed"):
        assert cli.main([stage, *args], spark) == 0
    assert w.calls.meter().first() == calls and sorted(map(str, w.edges.read().collect())) == graph
    assert cli.main(["verify", *args], spark) == 1  # most relations of the vocabulary have no edge here
    assert all(f.startswith("empty relation") for f in w.verify())


def test_questions(space, spark, capsys):
    w, args = space
    assert cli.main(["ask", *args, "--question", "Whom does Birch supply?"], spark) == 0
    found = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert found["answerable"] and found["route"] == "both" and found["citations"] and set(found["citations"]) <= set(found["retrieved"])
    server = cli.service(w, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.load(urllib.request.urlopen(f"{url}/health"))["entities"] == 3
        post = lambda path, body: urllib.request.urlopen(urllib.request.Request(url + path, json.dumps(body).encode(), method="POST")).read().decode()
        assert json.loads(post("/ask", {"question": "Whom does Birch supply?"}))["claims"] == found["claims"]
        said = [x.split("\n")[0] for x in post("/ask/stream", {"question": "Whom does Birch supply?"}).strip().split("\n\n")]
        assert said == ["event: retrieved", "event: claim", "event: done"]
        for body in ({}, {"question": ""}, {"question": 3}, {"question": "x" * 1001}):
            with pytest.raises(urllib.error.HTTPError, match="422"):
                post("/ask", body)
        with pytest.raises(urllib.error.HTTPError, match="404"):
            post("/other", {})
    finally:
        server.shutdown()
