"""URL filters: path rules first, then naive Bayes over host words found by unigram Viterbi."""

from __future__ import annotations

import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import materialize

#: Words of the segmentation's unigram table and tokens of the classifier that are broadcast, the most frequent first; the others are met by joins.
VOCABULARY, TOKENS = 50_000, 100_000
#: Hosts whose words a worker remembers.
HOSTS = 200_000
#: What each letter of an unknown stretch costs.
LETTER = 2.3
_LABEL = re.compile(r"[^0-9a-z\u0080-\U0010ffff]+")

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls without one.

    A rule fits its host and all subdomains if the path starts with its own; of
    rules of one length the last by text wins.
    """
    out, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out, verdict = F.when(fits, name + start).otherwise(out), F.when(fits, what).otherwise(verdict)
    return out, verdict


class Segmenter:
    """Splits joined words by the most probable sequence of a unigram table; unknown stretches cost by length.

    lengths: those that words of the whole table have, which is no more than the
    root of twice its letters; words of other lengths needn't be looked for.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, lengths: list[int] | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -log(n / self.total) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts} if lengths is None else lengths, reverse=True)
        self.unknown = log(self.total)
        self.hosts: dict[str, list[str]] = {}

    def split(self, label: str, more: dict[str, float] = {}) -> list[str]:
        """Viterbi: the cheapest way to each place; of equal ways the one with the longer last word. more: costs of words beside the table.

        An unknown stretch may have any length: the cheapest one that ends at a
        place goes on from the one before or begins there.
        """
        size = len(label)
        best, back = [0.0] * (size + 1), [0] * (size + 1)
        stretch, began = float("inf"), 0
        for end in range(1, size + 1):
            fresh = best[end - 1] + self.unknown
            if fresh < stretch:
                stretch, began = fresh, end - 1
            stretch += LETTER
            low, at = stretch, began
            for length in self.lengths:
                if length > end:
                    continue
                word = label[end - length : end]
                cost = self.cost.get(word)
                cost = more.get(word) if cost is None and more else cost
                if cost is not None and ((cost := cost + best[end - length]) < low or cost == low and end - length < at):
                    low, at = cost, end - length
            best[end], back[end] = low, at
        out, end = [], size
        while end:
            out.append(label[back[end] : end])
            end = back[end]
        return out[::-1]

    def pieces(self, host: str) -> set[str]:
        """Stretches of a host's labels that may be words outside the table."""
        labels = {_shape(x) for x in _LABEL.split(host) if x}
        return {x[a : a + n] for x in labels for n in self.lengths for a in range(len(x) - n + 1)} - self.cost.keys()

    def host(self, host: str, more: list[dict] | None = None) -> list[str]:
        """Features of a host: its words, and its last label as a whole. more: word and n of its words outside the table."""
        found = self.hosts.get(host)
        if found is None:
            if len(self.hosts) > HOSTS:
                self.hosts.clear()
            labels = [x for x in _LABEL.split(host) if x]
            costs = {x["word"]: -log(x["n"] / self.total) for x in more or ()}
            found = self.hosts[host] = ["h:" + w for label in labels for w in self.split(_shape(label), costs)] + (["t:" + labels[-1]] if labels else [])
        return found

    def tokens(self, host: str, path: str, more: list[dict] | None = None) -> list[str]:
        return self.host(host, more) + ["p:" + _shape(x) for x in _LABEL.split(path.lower()) if x]


def _shape(token: str) -> str:
    """Digits as their number, so that ids don't swell the vocabulary."""
    return re.sub("[0-9]+", lambda m: "0" * min(len(m[0]), 8), token)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages(page_id, url, html).

    A fitting rule decides. For the rest, multinomial naive Bayes over host words
    and path tokens does; it learns from the urls that rules decide, over all
    rows, with one added to each count. Host words come from a unigram table of
    the words in all pages' titles. score is the log odds of a block, null where
    a rule decided. A null url, or one without ``://``, has an empty host and
    path. Without urls of both kinds, all the rest are allowed. A tie allows.

    Words and tokens are counted in tasks first; the most frequent VOCABULARY
    words and TOKENS tokens are broadcast. If there are more, the stretches of
    each distinct host meet the other words in a join, and tokens outside the
    head, summed per url, meet their counts in another. Repeated rows are judged
    alike.
    """
    spark = pages.sparkSession
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    vocabulary = materialize(words.groupBy("word").agg(F.count("*").alias("n")), "title_words")
    word_kinds, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    lengths = [r[0] for r in vocabulary.select(F.char_length("word")).distinct().collect()]
    top = vocabulary.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    segmenter = spark.sparkContext.broadcast(Segmenter(dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist())), total, lengths))

    host, path = host_of(F.col("url").cast("string")), path_of(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "verdict": verdict})

    def stretches(batches):
        split = segmenter.value
        for batch in batches:
            found = [(h, x) for h in batch.column("host").to_pylist() for x in split.pieces(h)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["host", "word"])

    more = F.lit(None).cast("array<struct<word: string, n: bigint>>")
    if word_kinds > VOCABULARY:
        pieces = urls.select("host").distinct().mapInArrow(stretches, "host string, word string").join(vocabulary, "word")
        rare = pieces.groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("more"))  # a host's own stretches only
        urls = materialize(urls.join(rare, "host", "left").select("page_id", "host", "path", "rule", "verdict", "more"), "urls")
    else:
        urls = urls.withColumn("more", more)

    def count(batches):
        split = segmenter.value
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for h, p, v, m in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "verdict", "more"))):
                for t in split.tokens(h, p, m):
                    found[t, v] = found.get((t, v), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "verdict", "n"])

    learned = urls.filter("verdict is not null")
    shares = {r.verdict: r.n for r in learned.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    block = F.coalesce(F.sum(F.when(F.col("verdict") == "block", F.col("n"))), F.lit(0)).alias("block")
    allow = F.coalesce(F.sum(F.when(F.col("verdict") == "allow", F.col("n"))), F.lit(0)).alias("allow")
    table = materialize(learned.mapInArrow(count, "token string, verdict string, n long").groupBy("token").agg(block, allow), "tokens")
    kinds, blocks, allows = table.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    rows = table.orderBy(F.desc(F.col("block") + F.col("allow")), "token").limit(TOKENS).toArrow()
    weight = {t: log((b + 1) / (blocks + kinds)) - log((a + 1) / (allows + kinds)) for t, b, a in zip(*(rows.column(c).to_pylist() for c in ("token", "block", "allow")))}
    both = min(shares.get("block", 0), shares.get("allow", 0)) > 0
    prior = log(shares["block"] / shares["allow"]) if both else 0.0
    model = spark.sparkContext.broadcast((weight if both else {}, prior))

    beyond = both and kinds > TOKENS

    def decide(batches):
        split, (odds, start) = segmenter.value, model.value
        key = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            columns = {c: batch.column(c) for c in ("page_id", "host", "path", "rule", "verdict")}
            keys, scores, tails = [], [], []
            for h, p, v, m in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "verdict", "more"))):
                tokens = [] if v else split.tokens(h, p, m)
                key += 1
                keys.append(key)
                scores.append(None if v else sum([odds.get(t, 0.0) for t in tokens], start))
                tails.append([{"token": t, "k": k} for t, k in Counter(t for t in tokens if t not in odds).items()] if beyond else None)
            tail = pa.array(tails, pa.list_(pa.struct([("token", pa.string()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(scores, pa.float64()), pa.array(keys, pa.int64()), tail], [*columns, "score", "key", "tail"])

    schema = "page_id long, host string, path string, rule string, verdict string, score double, key long, tail array<struct<token: string, k: bigint>>"
    scored = urls.mapInArrow(decide, schema)
    score = F.col("score")
    if beyond:
        scored = materialize(scored, "scores")
        odds = F.log((F.col("block") + 1) / F.lit(float(blocks + kinds))) - F.log((F.col("allow") + 1) / F.lit(float(allows + kinds)))
        rest = scored.select("key", F.explode("tail").alias("t")).select("key", "t.token", "t.k").join(table, "token")
        scored = scored.join(rest.groupBy("key").agg(F.sum(F.col("k") * odds).alias("rest")), "key", "left")
        score = score + F.coalesce("rest", F.lit(0.0))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
