import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import context_tree, language_id, licenses, lm_score, quality, url_filter
from quillgraph.llm.context_tree import ContextTree


def part(i, of):
    return zlib.crc32(str(i).encode()) % of if i is not None else 0


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_language_id(odd_docs, sf_docs, no_docs, spark):
    rows = {r.doc_id: r for r in sf_docs.collect()}
    found = language_id.identify(sf_docs).collect()
    assert len(found) == len(rows) and all(r.held_out == (part(r.doc_id, 4) == 2) for r in found)
    held = [r for r in found if r.held_out and rows[r.doc_id].lang]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r for r in language_id.identify(odd_docs).collect()}
    assert language_id.identify(odd_docs).count() == odd_docs.count()
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (3, 4, 5, 14))
    assert language_id.identify(no_docs).count() == 0
    alone = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(alone).first().lang_pred == "und"


def test_language_does_not_leak(sf_docs):
    """Languages and ids of held-out rows take no part: other labels there change nothing."""
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = sf_docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(str, language_id.identify(sf_docs).collect())) == sorted(map(str, language_id.identify(other).collect()))


def brute_ppm(texts, depth):
    """P(byte after context) by recursion over counts."""
    counts: dict[bytes, Counter] = {}
    for t in texts:
        data = b"\n" * depth + t + b"\n"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                counts.setdefault(data[i - d : i], Counter())[data[i]] += 1

    def p(context):
        if not context:
            shorter = np.full(256, 1 / 256)
        else:
            shorter = p(context[1:])
        n = counts.get(context)
        if not n:
            return shorter
        out, total = np.zeros(256), sum(n.values())
        rest = sum(shorter[b] for b in range(256) if b not in n)
        for b in range(256):
            if b in n:
                out[b] = n[b] / (total + (len(n) if rest > 0 else 0))
            else:
                out[b] = len(n) / (total + len(n)) * shorter[b] / rest
        return out

    return p


@pytest.mark.parametrize("fewest,dense", [(1, 48 << 20), (2, 48 << 20), (3, 48 << 20), (1, 2048 * 9), (100, 48 << 20), (1, 0)])
def test_ppm_table_is_exact(fewest, dense, monkeypatch):
    """Whatever part of the contexts is dense, the code lengths are those of all contexts."""
    monkeypatch.setattr(language_id, "FEWEST", fewest)
    monkeypatch.setattr(language_id, "DENSE", dense)
    texts = {"a": [b"abracadabra abra", b"cad bra"], "b": [b"zig zag zigzag", b"bra zag"]}
    models = language_id.Models(["a", "b"], [0.5, 0.5], texts)
    for k, lang in enumerate("ab"):
        p = brute_ppm(texts[lang], language_id.DEPTH)
        for text in (b"abra zig", b"q", b"", b"zagabra"):
            data = b"\n" * language_id.DEPTH + text + b"\n"
            bits = -sum(math.log2(p(data[i - language_id.DEPTH : i])[data[i]]) for i in range(language_id.DEPTH, len(data)))
            assert abs(models.score([text])[0][0, k] * (len(text) + 1) - bits) < 1e-3 * bits


def test_language_query_is_the_brute_force(spark):
    """The query's predictions and code lengths, from the learning rows alone; a language with long texts only has a model too."""
    texts = ["abracadabra abra cad", "zig zag zigzag zog", "bra cad dabra", "zog zig zag", "kla klo klu " * 3000, "kla klu klo"]
    rows = [(n, texts[n % 6], "abzbzkk"[n % 6] if n % 6 < 5 else None) for n in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = [(t, lang) for i, t, lang in rows if part(i, 4) != 2 and lang]
    found = {r.doc_id: r for r in language_id.identify(frame).collect()}
    langs = sorted({lang for _, lang in learn})
    p = {x: brute_ppm([t.encode() for t, lang in learn if lang == x and len(t) <= 20000] or [min((t for t, lang in learn if lang == x), key=len).encode()], 4) for x in langs}
    for i, t, _ in rows:
        if len(t) < 100:
            data = b"\n" * 4 + t.encode() + b"\n"
            bits = {x: -sum(math.log2(p[x](data[k - 4 : k])[data[k]]) for k in range(4, len(data))) for x in langs}
            prior = Counter(lang for _, lang in learn)
            best = min(langs, key=lambda x: bits[x] - math.log2(prior[x]))
            assert found[i].lang_pred == best and abs(found[i].bits_per_byte * (len(t) + 1) - bits[best]) < 1e-3 * bits[best]


def test_walk_matches_lookup():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abc "), n).tolist()) for n in (0, 1, 5, 200, 3000)]
    codes, _ = context_tree.grams(texts, 4)
    contexts = [np.unique((codes >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)) for d in range(5)]
    tree = ContextTree([contexts[0], *(c[::2] if d == 4 else c for d, c in enumerate(contexts[1:], 1))])
    buffer, starts, ends = context_tree.lay_out(texts, 4)
    node = tree.deepest(buffer, 4)
    for i in range(4, len(buffer)):
        best = 0
        for d in range(1, 5):
            code = sum(int(buffer[i - 1 - k]) << 8 * k for k in range(d))
            n = int(tree.number(np.array([code], np.uint64), d)[0])
            if n < 0:
                break
            best = n
        assert node[i - 4] == best
    table = rng.random(tree.size * 256)
    want = [sum(table[node[i - 4] * 256 + buffer[i]] for i in range(s, e)) for s, e in zip(starts, ends)]
    assert np.allclose(tree.totals(texts, table), want)


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute_ctw(texts, depth):
    """A function from (context of depth bytes, byte) to the log10 of its probability, by recursion over the bits that followed each context."""
    seen = {}  # (context, bit prefix) -> [zeros, ones]
    for t in texts:
        data = b"\n" * depth + t + b"\n"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for length in range(8):
                    seen.setdefault((data[i - d : i], (1 << length) | data[i] >> (8 - length)), [0, 0])[data[i] >> (7 - length) & 1] += 1
    children = {}
    for context, prefix in seen:
        if context:
            children.setdefault((context[1:], prefix), []).append((context, prefix))

    @functools.cache
    def weighted(node):
        own = log_kt(*seen[node])
        return own if len(node[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted(c) for c in children[node]))

    def estimate(context, prefix):
        """The mixture over the contexts that the prefix followed; what is left goes to the longest."""
        p, left = 0.5, 1.0
        given = 0.0
        for d in range(depth + 1):
            node = (context[depth - d :], prefix)
            if node not in seen:
                break
            zeros, ones = seen[node]
            kt = (ones + 0.5) / (zeros + ones + 1)
            p = given + left * kt
            own = 1.0 if d == depth else math.exp(log_kt(zeros, ones) + math.log(0.5) - weighted(node))
            given, left = given + left * own * kt, left * (1 - own)
        return p

    def log_p(context, byte):
        out = 0.0
        for length in range(8):
            one = estimate(context, (1 << length) | byte >> (8 - length))
            out += math.log10(one if byte >> (7 - length) & 1 else 1 - one)
        return out

    return log_p


def test_brute_ctw_is_the_sequential_one():
    """Where a context was followed by the same bits before, the frozen estimate is the ratio of the weighted probabilities with and without one more bit."""
    texts, depth = [b"abab", b"abcab", b"ba"], 2
    log_p = brute_ctw(texts, depth)
    data = [(b"\n" * depth + t + b"\n") for t in texts]
    rows = [(x[i - depth : i], x[i]) for x in data for i in range(depth, len(x))]

    def weighted(context, bits):
        own = log_kt(bits_of(bits).count(0), bits_of(bits).count(1))
        if len(context) == depth:
            return own
        nexts = {c[depth - len(context) - 1 :] for c, _ in bits}
        return math.log(0.5) + np.logaddexp(own, sum(weighted(c, [r for r in bits if r[0].endswith(c)]) for c in nexts))

    def bits_of(bits):
        return [b for _, b in bits]

    for context, byte in ((b"ab", ord("a")), (b"ab", ord("c")), (b"ca", ord("b"))):
        want = 0.0
        for length in range(8):
            same = [(c, x >> (7 - length) & 1) for c, x in rows if (1 << length | x >> (8 - length)) == (1 << length | byte >> (8 - length))]
            if any(c == context for c, _ in same):
                want += weighted(b"", [*same, (context, byte >> (7 - length) & 1)]) - weighted(b"", same)
            else:
                break
        else:
            assert abs(log_p(context, byte) - want / math.log(10)) < 1e-9


def test_grams_table():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    table = lm_score.Table(keys[::2], np.arange(len(keys[::2])).astype(np.float32))
    found = table.get(keys)
    assert np.isnan(found[1::2]).all() and (found[::2] == np.arange(len(keys[::2]))).all()
    assert np.isnan(lm_score.Table(keys[:0], np.zeros(0, np.float32)).get(keys)).all()


@pytest.mark.parametrize("head,hold", [(1_000_000, 200_000), (0, 50), (300, 1)])
def test_scores_are_those_of_all_contexts(spark, head, hold, monkeypatch):
    """The query against context-tree weighting by recursion, over contexts of all lengths; broadcast or joined, in one batch of trees or many."""
    monkeypatch.setattr(lm_score, "GRAMS", head)
    monkeypatch.setattr(lm_score, "HOLD", hold)
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "zebra", "the zebra sat", "", None, "the the the the", "The cat SAT  on\nthe mat", "q", "日本 the"]
    rows = [(n, texts[n % len(texts)]) for n in range(33)] + [(40, "dog"), (40, "dog"), (None, "log")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = [" ".join(words(low(t))).encode() for _, t in rows]
    log_p = brute_ctw([t for (i, _), t in zip(rows, clean) if part(i, 10)], lm_score.DEPTH)
    want = []
    for (i, _), t in zip(rows, clean):
        data = b"\n" * lm_score.DEPTH + t + b"\n"
        want.append((str(i), sum(log_p(data[k - lm_score.DEPTH : k], data[k]) for k in range(lm_score.DEPTH, len(data)))))
    found = lm_score.score(frame).collect()
    for a, b in zip(sorted((str(r.doc_id), r.score) for r in found), sorted(want)):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 * abs(b[1])
    assert len(found) == len(want)


def test_a_text_seen_twice_is_told_apart(spark):
    """Texts that the learning rows hold twice score better than like ones that they hold once, and those better than ones they lack."""
    rng = random.Random(4)

    def fresh():
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(40))

    learn, held = [i for i in range(2000) if part(i, 10)], [i for i in range(2000) if not part(i, 10)]
    rows = [(learn.pop(), fresh()) for _ in range(60)]
    for _ in range(30):
        text = fresh()
        rows += [(learn.pop(), text), (learn.pop(), text)]
    unseen = [(held.pop(), fresh()) for _ in range(30)]
    found = {r.doc_id: r.bits_per_byte for r in lm_score.score(spark.createDataFrame(rows + unseen, "doc_id long, text string")).collect()}
    once, twice, never = ([found[i] for i, _ in x] for x in (rows[:60], rows[60:], unseen))
    assert max(twice) < min(once) and max(once) < min(never)


def check_lm(frame):
    rows = [(r.doc_id, low(r.text)) for r in frame.collect()]
    c = Counter()
    for i, t in rows:
        if part(i, 10):
            c.update([*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = [*words(t), "\n"]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((str(i), part(i, 10) == 0, len(w), sum(c[x] > 0 for x in w), n, base))
    found = lm_score.score(frame).collect()
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) <= 1e-6 * abs(b[5])
    assert len(got) == len(want) and all(r.score < 0 for r in found)
    return found


def test_lm_scores(odd_docs, no_docs, sf_docs, monkeypatch):
    check_lm(odd_docs)
    assert lm_score.score(no_docs).count() == 0
    monkeypatch.setattr(lm_score, "HEAD", 50)
    found = check_lm(sf_docs)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > 1.3 * sum(r.base_score for r in held)


def brute_quality(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>") if text else 0, dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality(odd_docs, no_docs, sf_docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for frame in (odd_docs, sf_docs):
        want = sorted((str(r.doc_id), *brute_quality(r.text)) for r in frame.collect())
        found = quality.judge(frame, labels).collect()
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
        assert got == want
        assert all(not (r.kept and r.base_failed) for r in found)
    assert quality.judge(no_docs, labels).count() == 0
    assert quality.judge(odd_docs, labels.limit(0)).filter("kept <> (not base_failed)").count() == 0
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    trusted = [r for r in found if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in trusted) / len(trusted) > 0.97


def test_quality_scores(spark):
    docs = spark.createDataFrame([(1, "good plain words here"), (2, "good plain talk"), (3, "bad noise !! noise"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    trusted = quality.trusted_rows(labels)
    assert {r.doc_id for r in trusted.collect()} == {1, 2}
    weights, threshold = quality.fit(docs, labels)
    assert len(weights.first().weights) == quality.BUCKETS and threshold <= 0.1


def test_url_filter(spark, sf_dir):
    urls = [
        "http://a.example.com/en/71?x#y", "https://Example.COM/en/8", "http://x.net/de/8", "http://www.example.net/de/81", "http://y.org/es/", "http://y.org/fr/1",
        "no scheme at all", None, "http://", "x://notcom/en/1", "http://com/en/", "http://a.b.com?/en/", "http://h.org#/es/", "http://a://b/c", "ftp://user@host.com:80/en/x", "HTTP://ÄB.com/en/",
    ]
    frame = spark.createDataFrame([(n, u, "<title>the rest</title>") for n, u in enumerate(urls)] + [(3, urls[3], None)], "page_id long, url string, html string")
    for pages in (frame, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        want = []
        for r in pages.collect():
            m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
            host, path = (low(m[1]), m[2]) if m else ("", "")
            fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            want.append((r.page_id, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None))
        found = url_filter.judge(pages).collect()
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in found]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert all(r.verdict in ("allow", "block") for r in found)
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_segmenter():
    s = url_filter.Segmenter({"cheap": 50, "pills": 40, "he": 60, "ap": 3, "the": 900, "rap": 20, "ist": 5, "therapist": 30})
    assert s.split("cheappills") == ["cheap", "pills"]
    assert s.split("therapist") == ["therapist"]
    assert s.split("") == [] and "".join(s.split("zzthezz")) == "zzthezz"


def test_licenses(odd_docs, no_docs):
    found = {r.doc_id: r for r in licenses.scan_licenses(odd_docs).collect()}
    assert [m.license for m in found[16].matches] == ["Apache-2.0", "MIT"] and found[16].dice == 1.0
    assert found[3].n_matches == 0 and found[1].license is None
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count() and licenses.scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize("name,text", licenses.TEMPLATES)
def test_license_templates(name, text):
    for around in ("{}", "some words before. {} And some after it.", "{}".replace("{}", "{} filler words that do not match")):
        matches = licenses.scanner().scan(around.format(text))
        assert [m[2] for m in matches] == [name] and matches[0][3] >= 0.8
    changed = text.split()
    if len(changed) > 20:
        changed[10] = "otherword"
        assert licenses.scanner().scan(" ".join(changed))[0][2] == name


def test_shards_are_whole(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    gram = rng.integers(0, 1 << 48, 400).astype(np.int64) & ~0xFFFC00 | 0
    gram = gram[np.argsort(gram >> 8 & 0xFFFF, kind="stable")]
    batches = [pa.RecordBatch.from_arrays([pa.array(gram[a : a + 7]), pa.array(np.arange(a, min(a + 7, 400)))], ["gram", "n"]) for a in range(0, 400, 7)]
    for hold in (1, 20, 10_000):
        monkeypatch.setattr(lm_score, "HOLD", hold)
        out = list(lm_score._shards(iter(batches), 2))
        assert np.concatenate([n for _, n in out]).tolist() == list(range(400))
        suffixes = [set((g >> np.uint64(8) & np.uint64(0xFFFF)).tolist()) for g, _ in out]
        assert sum(map(len, suffixes)) == len(set().union(*suffixes))


def test_all_trusted_rows_are_learned_from(spark):
    from quillgraph.llm import quality

    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id % 10 > 0 AS INT) AS quality")
    roles = {r.role: r["count"] for r in quality.trusted_rows(labels.union(labels)).groupBy("role").count().collect()}
    assert sum(roles.values()) == 27_000 and min(roles.values()) > 13_000
