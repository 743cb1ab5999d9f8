"""Language-model scores by context-tree weighting, beside a word unigram base."""

from __future__ import annotations

from collections import Counter
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bucket, documents, raw
from quillgraph.llm.context_tree import BLOCK, batches_of, codes_of, grams, inside, lay_out, merge_counts
from quillgraph.runtime import materialize

#: Longest context in bytes.
DEPTH = 5
#: Grams (a byte and its context) whose probabilities are broadcast, the most frequent ones; 12 bytes each and a table half full. All others are met by a join.
GRAMS = 1_000_000
#: The most frequent words, of at most WORD_BYTES bytes each, are looked up in a broadcast table; all others by a join.
HEAD, WORD_BYTES = 80_000, 48
#: Entries that a counting task holds before it passes them on, and grams whose trees are weighed together.
HOLD = 200_000
END = b"\n"
SMOOTH = 0.1
HALF = log(0.5)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count_words(batches):
    held: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in raw(batch.column("text")):
            held.update(words_of(text))
            held[END] += 1
            if len(held) > HOLD:
                yield rows()
    if held:
        yield rows()


def _count_grams(batches):
    """gram, n (in learning rows), seen (in all)."""
    parts: dict[bool, list] = {False: [], True: []}

    def rows(held: bool, counts):
        codes, n = counts
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(np.zeros(len(n), np.int64) if held else n.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n", "seen"])

    for batch in batches:
        texts = [b" ".join(words_of(t)) for t in raw(batch.column("text"))]
        for held, own in parts.items():
            some = [t for t, h in zip(texts, batch.column("held_out").to_pylist()) if h == held]
            own += [grams(some[a:b], DEPTH) for a, b in batches_of(some)]
            if len(own) > 1 and sum(len(c) for c, _ in own) > 8 * HOLD:
                own[:] = [merge_counts(own)]
                if len(own[0][0]) > 4 * HOLD:
                    yield rows(held, own.pop())
    for held, own in parts.items():
        if own:
            yield rows(held, merge_counts(own))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after a shift by 6."""
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones, in any order."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - 1.1447298858494002


class Level:
    """The nodes of one context length: a context and a bit prefix of the byte after it each.

    A key is context * 256 + prefix, a prefix k of l bits being 2**l + k.
    """

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.kt = (ones + 0.5) / (zeros + ones + 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def levels_of(gram: np.ndarray, n: np.ndarray, shortest: int) -> list[Level | None]:
    """The levels of a set of grams from the context length ``shortest`` to DEPTH, weighed upwards.

    A node's weighted probability of its bits is half its own KT probability and
    half the product of its children's, the contexts one byte longer; the
    longest have none. Each level gets log_p, own (the share of its own estimate
    in that mixture) and parent (places in the level above, shorter by a byte).
    """
    gram, n = gram[n > 0], n[n > 0].astype(np.float64)
    byte = gram & np.uint64(255)
    keys, ones = [], []
    for length in range(8):
        keys.append((gram & ~np.uint64(255)) | (np.uint64(1 << length) | byte >> np.uint64(8 - length)))
        ones.append(np.where(byte >> np.uint64(7 - length) & np.uint64(1), n, 0))
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    ones, total = np.bincount(inverse, np.concatenate(ones), len(keys)), np.bincount(inverse, np.tile(n, 8), len(keys))
    out: list[Level | None] = [None] * (DEPTH + 1)
    split = None
    for d in range(DEPTH, shortest - 1, -1):
        level = out[d] = Level(keys, total - ones, ones)
        own = _log_kt(level.zeros, level.ones)
        level.log_p = own if split is None else np.logaddexp(own, split) + HALF
        level.own = np.ones(len(keys)) if split is None else np.exp(np.minimum(own + HALF - level.log_p, 0))
        keys, level.parent = np.unique(level.keys & np.uint64((1 << 8 * d) - 1), return_inverse=True)
        split, ones, total = (np.bincount(level.parent, x, len(keys)) for x in (level.log_p, ones, total))
    return out


def _shards(batches, suffix: int):
    """Batches of (gram, n) that hold all of their contexts' last ``suffix`` bytes; rows come by those."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    mask = np.uint64((1 << 8 * suffix) - 1)
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, n = batch.column("gram").to_numpy().astype(np.uint64), batch.column("n").to_numpy()
        held.append((gram, n))
        size += len(gram)
        if size > HOLD:
            gram, n = (np.concatenate(x) for x in zip(*held))
            last = gram >> np.uint64(8) & mask
            cut = int(np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))[-1])
            if cut:
                yield gram[:cut], n[:cut]
            held, size = [(gram[cut:], n[cut:])], len(gram) - cut
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _weigh_up(batches):
    """key (a level-1 node), zeros, ones, split (the sum of its children's log probabilities)."""
    for gram, n in _shards(batches, 2):
        level = levels_of(gram, n, 2)[2]
        keys, at = np.unique(level.keys & np.uint64(0xFFFF), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(np.bincount(at, x, len(keys))) for x in (level.zeros, level.ones, level.log_p))], ["key", "zeros", "ones", "split"])


def top_of(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each level-1 key: what contexts of 0 and 1 byte add to the estimate of a one, the weight left for longer ones, and the estimate without those."""
    zeros, ones, split = (np.bincount(key, x, 1 << 16).reshape(256, 256) for x in (zeros, ones, split))
    own = _log_kt(zeros, ones)
    both = np.where(zeros + ones > 0, np.logaddexp(own, split) + HALF, 0)
    share = np.where(zeros + ones > 0, np.exp(np.minimum(own + HALF - both, 0)), 0)
    root_zeros, root_ones = zeros.sum(0), ones.sum(0)
    root = _log_kt(root_zeros, root_ones)
    root_share = np.exp(np.minimum(root + HALF - (np.logaddexp(root, both.sum(0)) + HALF), 0))
    root_kt = np.broadcast_to((root_ones + 0.5) / (root_zeros + root_ones + 1), (256, 256))
    kt = (ones + 0.5) / (zeros + ones + 1)
    given = root_share * root_kt + (1 - root_share) * share * kt
    alone = np.where(zeros + ones > 0, root_share * root_kt + (1 - root_share) * kt, root_kt)
    return given.ravel(), ((1 - root_share) * (1 - share)).ravel(), alone.ravel()


def weigh_down(gram: np.ndarray, n: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the weighted probability of each gram's byte after its context.

    Read downwards, the weighting is a mixture over the context lengths, with
    weights that the counts fix. A bit is estimated by the contexts that were
    followed by its prefix; the weight that is left goes to the longest of them.
    """
    levels = levels_of(gram, n, 2)
    given, left, alone = top
    byte = gram & np.uint64(255)
    finals: list[tuple[Level, np.ndarray]] = []
    for d in range(2, DEPTH + 1):
        level = levels[d]
        at = (level.keys & np.uint64(0xFFFF)).astype(np.int64) if d == 2 else level.parent
        above, rest = given[at], left[at]
        finals.append((level, above + rest * level.kt))
        given, left = above + rest * level.own * level.kt, rest * (1 - level.own)
    out = np.zeros(len(gram))
    for length in range(8):
        key = (gram & ~np.uint64(255)) | np.uint64(1 << length) | byte >> np.uint64(8 - length)
        one = alone[(key & np.uint64(0xFFFF)).astype(np.int64)]
        for d, (level, final) in enumerate(finals, 2):
            at, known = level.find(key & np.uint64((1 << 8 * (d + 1)) - 1))
            one[known] = final[at[known]]
        one = np.clip(one, 1e-12, 1 - 1e-12)
        out += np.log10(np.where(byte >> np.uint64(7 - length) & np.uint64(1), one, 1 - one))
    return out


class Table:
    """Values by 64-bit keys, found for all of an array at once: open addressing in a table at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, np.nan, np.float32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = keys[todo[free]]  # of several the last wins, the others go on
            won = self.keys[at] == keys[todo]
            self.values[at[won]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; nan for those that are not in the table."""
        slot = self._slot(keys)
        at = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero(at != keys)
        out[todo] = np.nan
        todo = todo[at[todo] != np.uint64(0xFFFFFFFFFFFFFFFF)]
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (at != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, slot = todo[go], slot[go]
        return out


def fit(rows: DataFrame) -> tuple[Table, DataFrame]:
    """(probabilities of the most frequent grams, gram and log_p of all others), over rows(text, held_out).

    The tree holds all contexts of up to DEPTH bytes of all learning rows; no
    context is left out, so it grows with them. Its nodes are dealt by the last
    two bytes of their contexts and weighed in two passes: upwards, after which
    the nodes of shorter contexts, 65,536 at most, meet on the driver; and
    downwards, for the grams that occur in any row.
    """
    spark = rows.sparkSession
    table = materialize(rows.select("text", "held_out").mapInArrow(_count_grams, "gram long, n long, seen long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "grams")
    last = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    shards = table.repartition(last).sortWithinPartitions(last)
    sums = shards.mapInArrow(_weigh_up, "key long, zeros double, ones double, split double")
    sums = sums.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("split").alias("split")).toArrow()
    top = spark.sparkContext.broadcast(top_of(*(sums.column(c).to_numpy() for c in ("key", "zeros", "ones", "split"))))

    def weigh(batches):
        def pairs():
            for batch in batches:
                seen.append(batch.column("seen").to_numpy())
                yield batch

        seen: list[np.ndarray] = []
        for gram, n in _shards(pairs(), 2):
            all_seen = np.concatenate(seen)
            seen[:] = [all_seen[len(gram) :]]
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(all_seen[: len(gram)]), pa.array(weigh_down(gram, n, top.value))], ["gram", "seen", "log_p"])

    probs = materialize(shards.mapInArrow(weigh, "gram long, seen long, log_p double"), "probs")
    size = F.floor(4 * F.log2("seen")).cast("int")
    least, total = None, 0
    for r in sorted(probs.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):  # some hundred rows
        total += r.n
        if total > GRAMS:
            break
        least = r["size"]
    head = probs.filter(size >= least) if least is not None else probs.limit(0)
    found = head.select("gram", F.col("log_p").cast("float").alias("log_p")).toArrow()
    return Table(found.column("gram").to_numpy().astype(np.uint64), found.column("log_p").to_numpy()), probs.filter(size < least) if least is not None else probs


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs(doc_id, text).

    Learns from the rows whose crc32(doc_id) mod 10 is not 0. Tokens are a
    text's words, A-Z in lower case, and one end. base_score: log10 of the
    smoothed unigram probability. score: log10 of the probability that
    context-tree weighting, with frozen statistics, gives the words, joined by
    single spaces, and the end, byte by byte; bits_per_byte is the same as a code
    length. A null text is empty: its only token is the end. Each row gives one
    row, repeated ones too; without learning rows the estimates are those of no
    counts.

    Words and grams outside the broadcast heads meet their values in joins,
    after each document has summed its own; so neither long documents nor
    frequent words gather in a task.
    """
    spark = docs.sparkSession
    rows = documents(docs, (bucket("doc_id", 10) == 0).alias("held_out"))
    train = rows.filter("not held_out").select("text")
    counts = materialize(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = log10(total + SMOOTH * (kinds + 1))
    top = counts.filter((F.octet_length("word") <= WORD_BYTES) & (F.col("word") != F.lit(bytearray(END)))).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    ends = counts.filter(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head = dict(zip(top.column("word").to_pylist(), np.log10(top.column("n").to_numpy() + SMOOTH).tolist()))
    table, probs = fit(rows)
    model = spark.sparkContext.broadcast((head, table))
    end_score = log10(ends + SMOOTH) - norm

    def totals(texts: list[bytes], table: Table):
        """Sums of the table's values over texts, and (text, gram, times) of what it lacks."""
        buffer, starts, ends = lay_out(texts, DEPTH)
        sums, rare = np.zeros(len(texts)), []
        for low in range(DEPTH, len(buffer), BLOCK):
            high = min(len(buffer), low + BLOCK)
            a, b = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
            if a >= b:
                continue
            codes = codes_of(buffer, low, high, DEPTH)
            value = table.get(codes)
            lacks = np.flatnonzero(np.isnan(value))
            value[lacks] = 0
            lacks = lacks[inside(starts[a:b], ends[a:b], low, high)[lacks]]
            if len(lacks):
                of = a + np.searchsorted(ends[a:b], lacks + low, "right")
                rare.append(of.astype(np.uint64) << np.uint64(8 * (DEPTH + 1)) | codes[lacks])  # an Arrow batch has fewer texts than the bits left can count
            edges = np.clip(np.stack((starts[a:b], ends[a:b]), 1) - low, 0, high - low).ravel()
            sums[a:b] += np.add.reduceat(np.append(value, np.float32(0)), edges, dtype=np.float64)[::2]
        found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *rare]), return_counts=True)
        return sums, zip((found >> np.uint64(8 * (DEPTH + 1))).tolist(), (found & np.uint64((1 << 8 * (DEPTH + 1)) - 1)).tolist(), times.tolist())

    def run(batches):
        known, table = model.value
        key = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            texts, out, tails = [], [], []
            for text in raw(batch.column("text")):
                words = words_of(text)
                texts.append(b" ".join(words))
                tail, n, base = [], 0, end_score
                for word, k in Counter(words).items():
                    if (value := known.get(word)) is None:
                        tail.append({"word": word, "k": k})
                    else:
                        n += k
                        base += k * (value - norm)
                key += 1
                out.append((key, len(words) + 1, n + (ends > 0), base))
                tails.append(tail)
            total, rare = np.zeros(len(texts)), [[] for _ in texts]
            for a, b in batches_of(texts):
                total[a:b], lacks = totals(texts[a:b], table)
                for of, gram, k in lacks:
                    rare[a + of].append({"gram": gram, "k": k})
            keys, tokens, known_n, base = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(tokens, pa.int64()),
                    pa.array(known_n, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(total),
                    pa.array([len(t) + 1 for t in texts], pa.int64()),
                    pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))),
                    pa.array(rare, pa.list_(pa.struct([("gram", pa.int64()), ("k", pa.int64())]))),
                ],
                ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "size", "tail", "rare"],
            )

    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, size long, tail array<struct<word: binary, k: long>>, rare array<struct<gram: long, k: long>>"
    scored = materialize(rows.mapInArrow(run, schema), "scores")
    seen = F.coalesce("n", F.lit(0))
    words = scored.select("key", F.explode("tail").alias("t")).select("key", "t.word", "t.k").join(counts, "word", "left")
    # (named lists of one form, so that one aggregation by key serves both)
    words = words.select("key", (F.col("k") * (F.log10(seen + F.lit(SMOOTH)) - F.lit(norm))).alias("base"), F.when(seen > 0, F.col("k")).otherwise(0).alias("known"), F.lit(0.0).alias("log_p"))
    rare = scored.select("key", F.explode("rare").alias("t")).select("key", "t.gram", "t.k").join(probs.select("gram", "log_p"), "gram")
    rare = rare.select("key", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("k") * F.col("log_p")).alias("log_p"))
    sums = words.unionByName(rare).groupBy("key").agg(F.sum("base").alias("more"), F.sum("known").alias("more_known"), F.sum("log_p").alias("more_log_p"))
    score = F.col("score") + F.coalesce("more_log_p", F.lit(0.0))
    return scored.drop("tail", "rare").join(sums, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score / F.col("size") * F.lit(3.321928094887362)).alias("bits_per_byte"),
    )
