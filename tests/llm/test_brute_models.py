"""Verdicts of the url filter and the quality rules against plain versions; texts full of white space and marks."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import language_id, quality, url_filter

LABEL = re.compile(r"[^0-9a-z\u0080-\U0010ffff]+")


def shape(token):
    return re.sub("[0-9]+", lambda m: "0" * min(len(m[0]), 8), token)


def cheapest(label, cost, unknown):
    """Over all ways to split, word by word from the end: (cost, words); of equal ones the longer last word."""
    best = [(0.0, [])]
    for end in range(1, len(label) + 1):
        ways = []
        for start in range(end):
            word = label[start:end]
            ways.append((best[start][0] + cost.get(word, unknown + 2.3 * (end - start)), start))
        low = min(w for w, _ in ways)
        start = min(s for w, s in ways if abs(w - low) < 1e-9)
        best.append((low, [*best[start][1], label[start:end]]))
    return best[-1][1]


def brute_urls(rows):
    """page_id, verdict, score of rows (page_id, url, html)."""
    titles = [re.search(r"(?is)<title[^>]*>(.*?)</title>", h or "") for _, _, h in rows]
    seen = Counter(w for t in titles if t for w in re.findall(r"[^\W\d_]+", t[1].lower()))
    total = sum(seen.values()) + 1
    cost, unknown = {w: -math.log(n / total) for w, n in seen.items()}, math.log(total)

    def tokens(host, path):
        labels = [x for x in LABEL.split(host) if x]
        found = ["h:" + w for x in labels for w in cheapest(shape(x), cost, unknown)] + (["t:" + labels[-1]] if labels else [])
        return found + ["p:" + shape(x) for x in LABEL.split(path.lower()) if x]

    parsed = []
    for page, url, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed.append((page, host, path, max(fits)[2] if fits else None))
    counts = {v: Counter(t for _, h, p, w in parsed if w == v for t in tokens(h, p)) for v in ("block", "allow")}
    pages = Counter(w for *_, w in parsed if w)
    kinds = len(counts["block"].keys() | counts["allow"].keys())
    odds = lambda t: math.log((counts["block"][t] + 1) / (counts["block"].total() + kinds)) - math.log((counts["allow"][t] + 1) / (counts["allow"].total() + kinds))
    both = pages["block"] and pages["allow"]
    out = []
    for page, host, path, verdict in parsed:
        known = [t for t in tokens(host, path) if counts["block"][t] + counts["allow"][t]]
        score = sum(map(odds, known), math.log(pages["block"] / pages["allow"])) if both else 0.0
        out.append((page, host, verdict or ("block" if score > 1e-9 else "allow"), None if verdict else score))
    return out


LONG = "donaudampfschifffahrtsgesellschaft"


@pytest.mark.parametrize("words,tokens", [(50_000, 100_000), (2, 3), (0, 0)])
def test_every_url_verdict_is_the_brute_force(spark, monkeypatch, words, tokens):
    """With long words, long hosts and paths, ties, repeated rows and clashing columns, whatever part of the tables is broadcast."""
    monkeypatch.setattr(url_filter, "VOCABULARY", words)
    monkeypatch.setattr(url_filter, "TOKENS", tokens)
    rng = random.Random(8)
    vocabulary = ["rose", "garden", "casino", "pills", "cheap", "news", LONG, "a", "an", "new", "ews"]
    rows = []
    for n in range(150):
        host = "".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4))) + rng.choice([".com", ".net", ".org", ".info", "7.info"])
        path = "/" + rng.choice(["en", "de", "es", "fr", ""]) + "/" + "-".join(rng.choice(vocabulary + ["42", "x1"]) for _ in range(rng.randrange(3)))
        rows.append((n, f"http://{host}{path}?q", f"<title>{' '.join(rng.choice(vocabulary) for _ in range(4))}</title>"))
    rows += [rows[0], (900, "http://" + "rosegarden" * 40 + ".info/" + "pills/" * 2000, None), (901, None, None), (902, "nothing", "<TITLE>rose</TITLE>"), (903, f"http://{LONG}casino.info/", None), (904, f"http://{'z' * 300}.info/q", None), (None, "http://neu.info/", "<title>")]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, host string, word string, n long").repartition(3)
    found = sorted(((str(r.page_id), r.host, r.verdict, r.score) for r in url_filter.judge(pages).collect()), key=str)
    want = sorted(((str(p), h, v, s) for p, h, v, s in brute_urls(rows)), key=str)
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert all((a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 1e-6) for a, b in zip(found, want))
    assert {x[2] for x in found} == {"allow", "block"}


def test_ties_allow(spark):
    pages = spark.createDataFrame([(1, "http://x.com/en/", None), (2, "http://y.net/de/", None), (3, "http://z.info/", None)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages).collect()} == {1: "block", 2: "allow", 3: {r[0]: r[2] for r in brute_urls([tuple(x) for x in pages.collect()])}[3]}


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hash_of(word):
    return signed(xxhash.xxh64(word.encode(), seed=42).intdigest())


def pair_of(a, b):
    """The hash of two longs in a row: the first one's is the second one's seed."""
    first = xxhash.xxh64(a.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return signed(xxhash.xxh64(b.to_bytes(8, "little", signed=True), seed=first).intdigest())


def brute_llr(rows, labels):
    """doc_id, llr of rows (doc_id, text), and the threshold, when all that labels trust are in the sample."""
    def grams(text):
        h = [hash_of(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [x % quality.BUCKETS for x in h] + [pair_of(a, b) % quality.BUCKETS for a, b in zip(h, h[1:])]

    trusted = {i for i, q in labels if q == 1 and i is not None}
    side = {i: signed(xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=42).intdigest()) % (1 << 30) % 2 for i in trusted}
    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if side.get(i) == 0 for g in grams(t))
    s, n = quality.SMOOTH, quality.SMOOTH * quality.BUCKETS
    weight = lambda g: math.log((target[g] + s) / (target.total() + n)) - math.log((raw[g] + s) / (raw.total() + n)) if target.total() else 0.0
    score = lambda t: sum(map(weight, g)) / (len(g) + quality.PRIOR) if (g := grams(t)) else 0.0
    held = [score(t) for i, t in rows if side.get(i) == 1]
    mean = sum(held) / len(held)
    return [score(t) for _, t in rows], mean - quality.DEVIATIONS * math.sqrt(sum((x - mean) ** 2 for x in held) / len(held))


def test_quality_verdicts_are_the_brute_force(spark, monkeypatch):
    """llr, threshold and kept; columns that clash in documents and labels."""
    monkeypatch.setattr(quality, "DEVIATIONS", 1.0)
    rng = random.Random(2)
    good, bad = [f"word{n}" for n in range(60)], [f"n0ise{n}" for n in range(60)]
    rows = [(n, " ".join(rng.choice(good if n % 3 else bad) for _ in range(rng.randrange(12, 60)))) for n in range(120)]
    rows += [(200, None), (201, ""), (202, "few words"), (203, " ".join(["same five words in a"] * 30)), rows[4], (None, "a row without an id that has more than ten words in it, really")]
    labels = [(n, 1 if n % 3 else 0) for n in range(0, 120, 2)] + [(None, 1), (200, 0), (2, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, quality long, hashes int, role string").repartition(3)
    marks = spark.createDataFrame([(*r, "x", [1]) for r in labels], "doc_id long, quality long, text string, hashes array<int>")
    scores, threshold = brute_llr(rows, labels)
    assert abs(quality.fit(docs, marks)[1] - threshold) < 1e-6
    want = sorted((str(i), round(s, 5)) for (i, _), s in zip(rows, scores))
    found = quality.judge(docs, marks).collect()
    got = sorted((str(r.doc_id), round(r.llr, 5)) for r in found)
    assert [x[0] for x in got] == [x[0] for x in want] and all(abs(a[1] - b[1]) < 2e-5 for a, b in zip(got, want))
    by_id = {str(i): s for (i, _), s in zip(rows, scores)}
    assert all(r.kept == (not r.base_failed and by_id[str(r.doc_id)] >= threshold) for r in found)
    assert {r.kept for r in found if not r.base_failed} == {True, False}


ENGLISH = "The museum opens at nine and closes at five; visitors who come in the morning find it quiet, and the guides have time for questions about every room. "
GERMAN = "Das Museum öffnet um neun und schließt um fünf; wer am Morgen kommt, findet es ruhig, und die Führer haben Zeit für Fragen zu jedem Raum. "


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(n, t * 3, lang, "s", 1) for n in range(0, 40, 2) for t, lang in ((ENGLISH, "en"), (GERMAN, "de"))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def odd_texts():
    table = "\n".join("\t".join(ENGLISH.split()[k : k + 6]) + "\t" + "\t".join(str(k * n) for n in range(12)) for k in range(12))
    code = "def opens(museum, hours):\n\tfor visitor in museum.visitors:\n\t\tif visitor.time < hours['morning']:\n\t\t\treturn visitor.questions[0]\n\n" * 4
    return {
        "spaces": ENGLISH * 25 + " " * 1_000_000,
        "tabs": ENGLISH * 25 + "\t" * 20_000,
        "controls": "\x01".join(ENGLISH.split()) + "\x00" * 3000,
        "table": table,
        "code": code,
        "digits": ENGLISH + "0123456789 " * 3000,
        "marks": ENGLISH + "=-" * 5000 + "│┼─" * 3000,
        "lines": "　 \n".join(ENGLISH.split()),
    }


def test_white_space_and_marks_do_not_outvote_words(spark, learned):
    """A prediction is that of the text without them, to the last digit."""
    texts = odd_texts()
    plain = {k: " ".join(re.findall(r"[^\W\d_]+", t)) for k, t in texts.items()}
    rows = [(1000 + n, t, None, "x", 0) for n, t in enumerate([*texts.values(), *plain.values(), GERMAN + "\t" * 9000])]
    found = {r.doc_id: r for r in language_id.identify(learned.unionByName(spark.createDataFrame(rows, learned.schema))).collect()}
    for n, name in enumerate(texts):
        a, b = found[1000 + n], found[1000 + n + len(texts)]
        assert (a.lang_pred, a.score, a.bits_per_byte) == (b.lang_pred, b.score, b.bits_per_byte) and a.lang_pred == "en", name
    assert found[1000 + 2 * len(texts)].lang_pred == "de"


def test_language_stage_keeps_prose_tables_and_code(spark, learned, sf_dir):
    texts = odd_texts()
    rows = [(1000 + n, t, None, "x", 0) for n, t in enumerate(texts.values())] + [(2000, "4711 " * 50 + "=" * 100, None, "x", 0), (2001, None, None, "x", 0)]
    docs = learned.unionByName(spark.createDataFrame(rows, learned.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, sf_dir).select("doc_id").collect()}
    assert kept >= {1000 + n for n in range(len(texts))} and not kept & {2000, 2001}


def test_gibberish_goes(spark, sf_docs, sf_dir):
    rng = random.Random(1)
    rows = [(10**6 + n, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)), None, "x", 0) for n in range(5)]
    docs = sf_docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, sf_dir).select("doc_id").collect()}
    assert not kept & {r[0] for r in rows}
