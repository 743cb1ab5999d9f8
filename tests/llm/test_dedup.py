import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash

from quillgraph.llm import exact_dedup, simhash


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for bare, members in groups.items():
        members.sort(key=lambda m: m[:3])
        out += [(m[3], members[0][3], len(members), n == 0, hashlib.sha256(bare.encode()).hexdigest()) for n, m in enumerate(members)]
    return sorted(out, key=str)


def test_exact_groups(odd_docs, sf_docs, no_docs):
    for frame in (odd_docs, sf_docs, no_docs):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        assert sorted(map(tuple, exact_dedup.exact_groups(frame).collect()), key=str) == brute_exact(rows)


def test_one_row_stays_of_repeated_ones(spark):
    """Rows that share ids: of each text one row is kept, and no other text goes with it."""
    rows = [(9, "same words"), (9, "same words"), (4, "r unique"), (1, "x  y"), (4, "x y"), (None, "x y"), (None, "alone"), (None, "alone"), (None, None), (2, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = exact_dedup.exact_groups(frame).collect()
    assert sorted(map(tuple, found), key=str) == brute_exact(rows)
    assert sum(r.kept for r in found) == 5


def test_exact_groups_has_no_python(sf_docs):
    plan = exact_dedup.exact_groups(sf_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!ow)", plan)


def brute_print(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, radius):
    """items: (doc_id, fingerprint)."""
    root = list(range(len(items)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(items):
        r = find(n)
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    return [low[find(n)] for n in range(len(items))]


def test_near_duplicates(odd_docs, sf_docs, no_docs):
    for frame in (odd_docs, sf_docs, no_docs):
        items = [(r.doc_id, brute_print(r.text)) for r in frame.collect()]
        want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(items, brute_components(items, 4))), key=str)
        assert sorted(map(tuple, simhash.near_duplicates(frame, width=4, radius=4).collect()), key=str) == want


def planted(seed, n):
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n)]
    for v in values[: n // 2]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                v ^= 1 << b
            values.append(v)
    return list(dict.fromkeys(values))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_find_every_class(spark, monkeypatch):
    values = planted(1, 120)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = brute_components([(n, v) for n, v in enumerate(values)], 4)
    for tile in (simhash.TILE, 3):
        monkeypatch.setattr(simhash, "TILE", tile)
        from quillgraph.operators.components import connected_components

        found = {r.node: r.component for r in connected_components(simhash.links(frame, 4)).collect()}
        classes = {}
        for n, v in enumerate(values):
            classes.setdefault(found.get(signed(v), signed(v)), []).append(n)
        assert sorted(map(tuple, classes.values())) == sorted(tuple(n for n in range(len(values)) if want[n] == c) for c in set(want))


@pytest.mark.parametrize(
    "rows",
    [
        [(1, 0), (None, 0x0F), (3, 0xFF)],  # only a row without an id joins the two
        [(1, 0), (2, 0x0F), (3, 0xFF)],
        [(5, 0), (5, 0xFFFFFFFF), (3, 0xFFFFFFFE)],  # one id on unlike texts
        [(None, 0), (None, 1), (7, 1 << 40), (None, 0xFFFF << 30), (2, 0xFFFF << 30 | 1), (None, 0xFFFF << 44), (None, 0xFFFF << 44)],
    ],
)
def test_components_without_ids_and_with_shared_ones(rows, spark, monkeypatch):
    frame = spark.createDataFrame([(i, signed(v)) for i, v in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs)
    found = simhash.near_duplicates(frame, radius=4).collect()
    want = [(i, f"{v:016x}", c) for (i, v), c in zip(rows, brute_components(rows, 4))]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_bk_tree():
    values = planted(3, 100)
    tree = simhash.BkTree(4)
    for n, v in enumerate(values):
        assert sorted(tree.near(v)) == [m for m in range(n) if (values[m] ^ v).bit_count() <= 4]
        tree.add(v)
