import random

import corpus_pipeline
import pytest

from quillgraph.llm import shingle_join


def brute_sets(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_jaccard(items):
    """The smallest id of each item's component, from all pairs."""
    sets = [brute_sets(t) for _, t in items]
    root = list(range(len(items)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(items)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for n, (i, _) in enumerate(items):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [least.get(find(n)) for n in range(len(items))]


@pytest.fixture(scope="module")
def edited():
    """Texts with 0 to 8 words changed, chains of edits, a line that all share, a large group, short and empty texts."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(400)]
    line = "this is a line that very many of the texts share with all of the others"
    out = [(1, ""), (2, None), (3, " \n"), (4, "two Words"), (5, "two words"), (6, "other words"), (None, "a b c d e f"), (8, "A b c d e f")]
    for n in range(60):
        text = [rng.choice(words) for _ in range(rng.choice((12, 60, 150)))]
        for _ in range(rng.choice((1, 3, 5))):
            out.append((100 + len(out), " ".join(text) + (f" {line}" if n % 2 else "")))
            text = list(text)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(len(text))] = rng.choice(words)
    base = [rng.choice(words) for _ in range(90)]
    for _ in range(60):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((100 + len(out), " ".join(text)))
    rng.shuffle(out)
    return out


def test_jaccard_components(edited, spark, monkeypatch):
    frame = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    want = sorted(map(str, zip((i for i, _ in edited), brute_jaccard(edited))))
    for common, tile, lowest in ((200_000, 4096, 64), (10, 4096, 2), (0, 4, 64)):
        monkeypatch.setattr(shingle_join, "LOWEST", lowest)
        monkeypatch.setattr(shingle_join, "COMMON", common)
        monkeypatch.setattr(shingle_join, "TILE", tile)
        found = shingle_join.near_duplicates(frame).collect()
        assert sorted(str((r.doc_id, r.component_id)) for r in found) == want


def test_near_stage_catches_edited_copies(edited, spark, sf_dir):
    rows = [(i, t, "en", "s", 1) for i, t in edited]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, frame, sf_dir).collect()}
    want = brute_jaccard(edited)
    # a row without an id stays where its component has no row with one
    assert kept == {i for (i, _), c in zip(edited, want) if i == c and (i is not None or c is None)}


@pytest.mark.parametrize("weak", ["char_length(text) % 40", "0 * char_length(text)", "char_length(text)"])
def test_unlike_texts_of_one_hash(edited, spark, monkeypatch, weak):
    """Texts whose first hash clashes keep nodes of their own."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(shingle_join, "_print", lambda text: F.expr(weak).cast("long"))
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    found = sorted((str(r.doc_id), str(r.component_id)) for r in shingle_join.near_duplicates(docs).collect())
    assert found == sorted((str(i), str(c)) for (i, _), c in zip(edited, brute_jaccard(edited)))


def test_members_have_a_partner_of_fitting_size(spark):
    """Texts that share a shingle but are too unlike in size to be similar don't meet; those of one size do."""
    line = "a line of words that all of these texts share in one place"
    texts = [(n, " ".join(f"w{n}x{k}" for k in range(size)) + " " + line) for n, size in ((1, 5), (2, 90), (3, 900))]
    alike = [(4, f"{texts[1][1]} end"), (5, f"{texts[1][1]} other end")]
    names = lambda rows: {r.node for r in shingle_join._members(shingle_join._firsts(spark.createDataFrame(rows, "node long, text string"), 5)).collect()}
    assert names(texts) == set()
    assert names(texts + alike) == {2, 4, 5}


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_chains_keep_all_fitting_pairs(batch):
    """Nodes that may be similar by a shingle at their places stay in one of its chains, wherever batches are cut."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(batch)
    rows = []
    for shingle in range(0, 60 * 16, 16):
        for _ in range(rng.choice((1, 2, 2, 3, 12))):
            size = rng.randrange(1, 400)
            place = rng.randrange(size - -(-4 * size // 5) + 1)
            rows.append((shingle, rng.randrange(10**6), size, int(shingle_join.most_size(np.array(size), np.array(place)))))
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    columns = [np.array(c) for c in zip(*rows)]
    packed = shingle_join.packed(columns[0], columns[2], columns[3])
    table = pa.table([pa.array(packed), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], ["shingle", "node", "size"])
    kept = [r for found in shingle_join._led(iter(table.to_batches(max_chunksize=batch))) for r in found.to_pylist()]
    chain = {}
    for r in kept:
        chain.setdefault(r["node"], set()).add(r["shingle"])
    fitting = 0
    for a, (s, u, n, reach) in enumerate(rows):
        for t, v, m, other in rows[:a]:
            if s == t and n <= other and m <= reach:
                fitting += 1
                assert chain[u] & chain[v]
    assert fitting > 5 and len(kept) < len(rows)
    whole = [r for found in shingle_join._led(iter(table.to_batches())) for r in found.to_pylist()]
    assert kept == whole


def test_long_unlike_texts_are_told_apart_by_sketches(spark, monkeypatch):
    """Whole sets are made for the pairs of similar texts only, also where a plain sketch has fewer bits than the sets shingles."""
    rng = random.Random(8)
    line = " ".join(f"shared{k}" for k in range(150))
    texts = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (4000, 4100, 4200)]
    texts.append(texts[2][:2000] + ["edited"] + texts[2][2001:] + [f"w{k}" for k in range(200)])
    rows = [(n, f"{line if n < 2 else ''} {' '.join(t)}") for n, t in enumerate(texts)]  # what more than two have comes last, so they wouldn't meet there
    written, seen = shingle_join.materialize, []

    def watched(df, name="step", light=False):
        found = written(df, name, light)
        seen.extend(found.count() for _ in range(name == "near"))
        return found

    monkeypatch.setattr(shingle_join, "materialize", watched)
    found = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 1), (2, 2), (3, 2)]
    assert sum(seen) == 1


def test_wide_sketches_rule_out_no_similar_sets():
    """Sets on both sides of a doubling of the bits are compared at the fewer bits; the bound holds for any two sets."""
    import numpy as np

    rng = np.random.default_rng(3)
    for size, other in ((1024, 1100), (2000, 2100), (2048, 2049), (4000, 4900), (1100, 1375)):
        every = np.unique(rng.integers(0, 2**63, 2 * (size + other)).astype(np.uint64))
        for both in (0, size // 2, size):
            a, b = np.sort(every[:size]), np.sort(np.concatenate((every[:both], every[size : size + other - both])))
            allowed = shingle_join.wide_alike(shingle_join.wide(a), shingle_join.wide(b), size + other)
            assert allowed or not shingle_join.similar(a, b)
            assert not (allowed and both == 0 and size > 1024)
