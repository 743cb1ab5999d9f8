"""The source audit against a plain version in Python's integers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_version(rows, least=3, listed=200):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(low)))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, c in docs if x == lang for t in c)
        kept = sorted(t for t, n in held.items() if n >= least)
        groups = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, c in docs:
            if x == lang:
                groups[s].update({t: c[t] for t in kept if t in c})
        total = sum(groups.values(), Counter())
        share = lambda c: [1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept]
        shares, whole = {s: share(c) for s, c in groups.items()}, share(total)
        for s, p in shares.items():
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p, q)), o) for o, q in shares.items() if o != s]
            terms = [((a - b) ** 2 // b, t) for a, b, t in zip(p, whole, kept) if groups[s][t] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, listed)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)] + ["Été", "日本", "x y", "it's", "A1b2", "Ünï", "🙂"]
    made = [(rng.choice(["en", "de", None]), f"s{min(rng.randrange(30), rng.randrange(30))}", " ".join(rng.choice(words[: rng.randrange(5, len(words))]) for _ in range(rng.randrange(60)))) for _ in range(260)]
    return [*made, ("en", None, "wAA waa WAA"), ("en", "silent", None), ("xx", "a", "alone"), ("xx", "b", ""), ("xx", "c", None), ("", "s1", "waa 1"), ("en", "long", "waa " * 700000 + "é" * 50)]


@pytest.mark.parametrize("chunk,slab,block", [(4096, 8, 32), (7, 2, 3), (1, 1, 1)])
def test_is_the_plain_version(spark, rows, monkeypatch, chunk, slab, block):
    """Whatever the sizes of chunks, slabs and blocks."""
    for name, value in (("CHUNK", chunk), ("SLAB", slab), ("BLOCK", block)):
        monkeypatch.setattr(divergence, name, value)
    some = rows if chunk > 1 else rows[:60]
    docs = spark.createDataFrame([(*r, 1, "x") for r in some], "lang string, source string, text string, n int, term string").repartition(3)
    assert found(divergence.audit(docs)) == plain_version(some)


def test_few_terms_are_listed(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(divergence.audit(docs, least=1, listed=4)) == plain_version(rows, 1, 4)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert found(divergence.audit(odd_docs, least=1)) == plain_version(rows, 1)
    assert divergence.audit(no_docs).count() == 0


def test_shares_are_exact():
    counts = np.array([0, 1, 999, 10**15 - 2, 123456789012345], np.int64)
    for total in (1, 7, 10**9 + 7, 3 * 10**15):
        want = [1 + 10**9 * (int(c) + 1) // total for c in counts if c < total]
        assert divergence._shares(counts[counts < total], np.array(total)).tolist() == want
