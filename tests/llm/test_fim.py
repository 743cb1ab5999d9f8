"""Fill-in-middle against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from quillgraph.llm import fim


@pytest.mark.parametrize("text", ["", "a", "é", "日本語🙂 x", "a" * 511 + "é" + "b" * 600, "🙂" * 3000, "".join(random.Random(1).choice("aé日🙂\n") for _ in range(5000))])
def test_rank_and_select(text):
    data = text.encode()
    bits = fim.Boundaries(np.frombuffer(data, np.uint8))
    starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    assert bits.total == len(text) == len(starts)
    at = np.arange(len(data) + 1)
    assert bits.rank(at).tolist() == [sum(s < x for s in starts) for x in (at if len(at) < 800 else [])] or len(at) >= 800
    assert bits.rank(at[[0, -1]]).tolist() == [0, len(starts)]
    if starts:
        assert bits.select(np.arange(len(starts))).tolist() == starts
        assert bits.rank(np.array(starts)).tolist() == list(range(len(starts)))


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_is_the_plain_version(spark, odd_docs):
    more = [(100 + k, t) for k, t in enumerate(["<P", "<P>", "x<S>y", "<M>", "<<S", "P><S", "<M<P<S", "日本🙂" * 40000, "é" * 3, "\n\n", "\x00a\x00"] * 6)]
    docs = odd_docs.select("doc_id", "text", "key", "n").unionByName(spark.createDataFrame([(i, t, "clash", 1) for i, t in more], "doc_id long, text string, key string, n long"))
    found = fim.transform(docs).withColumn("restored", fim.restored()).collect()
    texts = docs.collect()
    want = sorted((str(r.doc_id), *map(str, plain_version(r.doc_id, r.text)), r.text or "") for r in texts)
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.restored) for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        if r.form != "plain":
            text = r.restored.encode()
            assert text[: r.prefix_bytes].decode() == r.restored[: r.prefix_chars]
            assert text[r.prefix_bytes : r.prefix_bytes + r.middle_bytes].decode() == r.restored[r.prefix_chars : r.prefix_chars + r.middle_chars]


def test_marks_and_shares_are_parameters(spark, no_docs):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(300)], "doc_id int, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    found = fim.transform(docs, seed="other", plain=0, spm=100, marks=marks)
    rows = found.withColumn("restored", fim.restored(marks=marks)).collect()
    assert {r.form for r in rows} == {"spm"} and all(r.output.startswith("<|suf|>") and r.restored == f"text number {r.doc_id}" for r in rows)
    assert {r.form for r in fim.transform(docs, plain=100).collect()} == {"plain"}
    assert fim.transform(no_docs).count() == 0
