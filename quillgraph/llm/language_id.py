"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.llm.common import bucket, documents, raw
from quillgraph.llm.context_tree import ContextTree, batches_of, grams, merge_counts

#: The bounds of the sample that the models are fitted on: rows in all, shared evenly by the languages, and the longest text (characters).
SAMPLE_ROWS, SAMPLE_CHARS = 1600, 20_000
#: The models' order: the longest context.
DEPTH = 4
#: Contexts that occur this often, the most frequent ones that fit into DENSE bytes, have a row for all bytes; all others are kept sparse.
FEWEST, DENSE = 6, 48 << 20
UNKNOWN = "und"
#: What isn't part of a word, in any number: one space to the models.
BETWEEN = r"[^\p{L}\p{M}]+"


class Sparse:
    """A language's contexts of one depth that have no dense row: the escape's share, and the bytes seen, of each."""

    def __init__(self, context: np.ndarray, escape: np.ndarray, gram: np.ndarray, value: np.ndarray):
        self.context, self.escape, self.gram, self.value = context, escape, gram, value

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def deepen(self, context: np.ndarray, byte: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 of the probabilities of bytes after contexts, from those after the next shorter ones; and which contexts are known."""
        at, known = self._find(self.context, context)
        if not known.any():
            return shorter, known
        spot, seen = self._find(self.gram, (context << np.uint64(8)) | byte.astype(np.uint64))
        return np.where(seen, self.value[spot], np.where(known, shorter + self.escape[at], shorter)), known


class Models:
    """One PPM model a language, with escape probabilities, compiled into tables.

    A language's probability of a byte after a context is its count there over
    the counts plus the number of different bytes seen (method C); a byte not
    seen there has the escape's share of its probability after the next shorter
    context, bytes seen in the longer one excluded; after the empty context
    comes the same share for all bytes. Counts are frozen, and none is left out.
    A context that a language has not seen gives what the next shorter one
    gives, so all languages can share one tree of frequent contexts, with a row
    of 256 probabilities a language; rarer contexts, longer than those, hold the
    bytes seen and the escape's share. What is dense decides the cost, no score.
    """

    def __init__(self, langs: list[str], priors: list[float], texts: dict[str, list[bytes]]):
        self.langs = langs
        self.priors = np.log2(np.asarray(priors, np.float64))
        counts = {lang: merge_counts([grams(texts[lang][a:b], DEPTH) for a, b in batches_of(texts[lang])]) for lang in langs if texts.get(lang)}
        most = max(1, min(1 << 15, DENSE // (1024 * max(1, len(langs)))))
        self.tree = ContextTree(self._contexts(list(counts.values()), most))
        table = np.empty((self.tree.size, 256, len(langs)), np.float32)
        self.sparse: list[list[Sparse | None]] = []
        longer = np.zeros(self.tree.size, bool)
        for k, lang in enumerate(langs):
            p = self._compile(counts.get(lang))
            table[:, :, k] = np.log2(np.maximum(p, 1e-30))
            self.sparse.append(self._rest(counts.get(lang), p, longer))
        self.table = table.reshape(self.tree.size * 256, len(langs))
        #: nodes of which some language has longer contexts than the tree
        self.longer = longer
        self.node_depth = np.repeat(np.arange(self.tree.depth + 1), np.diff(self.tree.first))

    @staticmethod
    def _contexts(counts: list, most: int) -> list[np.ndarray]:
        if not counts:
            return [np.zeros(1, np.uint64)]
        codes, n = merge_counts(counts)
        found = []
        for d in range(1, DEPTH + 1):
            context = (codes >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
            known, total = merge_counts([(context, n)])
            keep = total >= FEWEST
            found.append((known[keep], total[keep]))
        sizes = np.concatenate([t for _, t in found])
        least = np.sort(sizes)[-most] if len(sizes) > most else 0
        return [np.zeros(1, np.uint64), *(c[t > least] if least else c for c, t in found)]

    def _compile(self, counts) -> np.ndarray:
        """Probabilities of each byte after each of the tree's contexts."""
        tree = self.tree
        p = np.empty((tree.size, 256))
        for d in range(tree.depth + 1):
            low, high = tree.first[d], tree.first[d + 1]
            n = np.zeros((high - low, 256))
            if counts is not None:
                node = tree.number((counts[0] >> np.uint64(8)) & tree._mask(d), d)
                known = node >= 0
                np.add.at(n, (node[known] - low, (counts[0][known] & np.uint64(255)).astype(np.int64)), counts[1][known])
            shorter = p[tree.parent[low:high]] if d else np.full((1, 256), 1 / 256)
            seen = n > 0
            kinds = seen.sum(1, keepdims=True)
            total = n.sum(1, keepdims=True)
            left = np.where(seen, 0, shorter)
            rest = left.sum(1, keepdims=True)
            escape = np.where(rest > 0, kinds / np.maximum(total + kinds, 1), 0)
            own = np.where(seen, n / np.maximum(total + np.where(rest > 0, kinds, 0), 1), left / np.maximum(rest, 1e-300) * escape)
            p[low:high] = np.where(total > 0, own, shorter)
        return p

    def _rest(self, counts, p: np.ndarray, longer: np.ndarray) -> list[Sparse | None]:
        """A language's contexts that the tree lacks, by depth; marks the tree's nodes that they go on from."""
        tree = self.tree
        out: list[Sparse | None] = [None] * (DEPTH + 1)
        if counts is None:
            return out
        before = None  # the depth above: sparse grams and their probabilities, contexts and escape factors
        for d in range(1, DEPTH + 1):
            gram, n = merge_counts([(counts[0] & np.uint64((1 << 8 * (d + 1)) - 1), counts[1])])
            context = gram >> np.uint64(8)
            inside = tree.number(context, d) >= 0 if d <= tree.depth else np.zeros(len(gram), bool)
            # sorted by context, as a context's order is that of the gram without its byte once the byte goes last
            order = np.argsort(context[~inside], kind="stable")
            context, byte, n = context[~inside][order], (gram[~inside][order] & np.uint64(255)).astype(np.int64), n[~inside][order].astype(np.float64)
            if not len(context):
                before = None
                continue
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            names = context[first]
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
            total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(context))).astype(np.float64)
            parent = tree.number(names & tree._mask(d - 1), d - 1) if d - 1 <= tree.depth else np.full(len(names), -1)
            longer[parent[parent >= 0]] = True
            # the probability of each seen byte after the next shorter context, which is in the tree or sparse itself and has seen the byte too
            shorter = p[np.maximum(parent[which], 0), byte]
            sparse = parent[which] < 0
            if sparse.any():
                gone = (context[sparse] & tree._mask(d - 1)) << np.uint64(8) | byte[sparse].astype(np.uint64)
                shorter[sparse] = before[1][np.searchsorted(before[0], gone)]
            rest = np.maximum(1 - np.add.reduceat(shorter, first), 0)
            rest[kinds == 256] = 0
            some = rest > 1e-12
            escape = np.where(some, kinds / (total + kinds) / np.maximum(rest, 1e-300), 0)
            value = n / (total + np.where(some, kinds, 0))[which]
            grams_here = context << np.uint64(8) | byte.astype(np.uint64)
            order = np.argsort(grams_here)
            before = (grams_here[order], value[order])
            out[d] = Sparse(names, np.log2(np.maximum(escape, 1e-30)).astype(np.float32), grams_here[order], np.log2(np.maximum(value[order], 1e-30)).astype(np.float32))
        return out

    def _deepen(self, node: np.ndarray, block: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Log probabilities at the tree's deepest nodes, carried on to contexts that are longer than those."""
        at = np.flatnonzero(self.longer[node])
        if not len(at):
            return value
        gap = len(block) - len(node)
        depth = self.node_depth[node[at]]
        byte = block[gap + at]
        context = np.zeros(len(at), np.uint64)
        for back in range(DEPTH):
            context |= block[gap + at - 1 - back].astype(np.uint64) << np.uint64(8 * back)
        for k, by_depth in enumerate(self.sparse):
            alive = np.ones(len(at), bool)
            for d in range(1, DEPTH + 1):
                table = by_depth[d]
                here = np.flatnonzero(alive & (depth < d))
                if table is None or not len(here):
                    alive &= depth >= d
                    continue
                value[at[here], k], known = table.deepen(context[here] & np.uint64((1 << 8 * d) - 1), byte[here], value[at[here], k])
                alive[here] = known
        return value

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a byte under each language's model, posterior of each language) for each text."""
        total = np.concatenate([self.tree.totals(texts[a:b], self.table, self._deepen, DEPTH) for a, b in batches_of(texts)]) if texts else np.zeros((0, len(self.langs)))
        sizes = np.array([len(t) + 1 for t in texts], np.float64)[:, None]
        weight = total + self.priors
        weight = np.exp2(np.maximum(weight - weight.max(1, keepdims=True), -1000)) if len(texts) else weight
        return -total / sizes, weight / weight.sum(1, keepdims=True)


def words(text: Column | str) -> Column:
    """A text's words in lower case with one space between two: what is scored, so that no other characters outvote them."""
    return F.lower(F.btrim(F.regexp_replace(text, BETWEEN, " ")))


def fit(docs: DataFrame) -> Models:
    """Models from the learning rows of docs(doc_id, text, lang): crc32(doc_id) mod 4 is not 2, text and lang not null.

    Languages and their shares are counted over all such rows. Texts come from a
    sample of about SAMPLE_ROWS rows, as many of each language, chosen by a hash
    of doc_id, of texts of at most SAMPLE_CHARS characters, whole. Of a language
    with longer texts only, the shortest one is taken, whole.
    """
    rows = documents(docs, F.col("lang").cast("string").alias("lang"), bucket("doc_id", 4).alias("part")).filter("part <> 2 and text is not null and lang is not null")
    letters = F.col("text").rlike(r"\p{L}")
    fits = letters & (F.char_length("text") <= SAMPLE_CHARS)
    shares = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(fits).alias("fit")).orderBy("lang").collect()
    if not shares:
        return Models([], [], {})
    each = SAMPLE_ROWS / len(shares)
    rate = F.create_map(*[x for r in shares for x in (F.lit(r.lang), F.lit(min(1.0, each / max(1, r.fit))))])
    chosen = rows.filter(fits).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)).select("lang", "text")
    if long := [r.lang for r in shares if not r.fit]:
        shortest = F.min_by("text", F.struct(F.char_length("text"), "doc_id"))
        chosen = chosen.unionByName(rows.filter(letters & F.col("lang").isin(long)).groupBy("lang").agg(shortest.alias("text")))
    texts: dict[str, list[bytes]] = {}
    for row in chosen.select("lang", words("text").alias("text")).toLocalIterator():
        texts.setdefault(row.lang, []).append(row.text.encode())
    total = sum(r.n for r in shares)
    return Models([r.lang for r in shares], [r.n / total for r in shares], {k: sorted(v) for k, v in texts.items()})


def identify(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row of docs(doc_id, text, lang).

    The code length of a text's words (`words`) is exact under each language's
    frozen model: white space, digits, marks and control characters between
    them, in any number, are one space. The shortest, with the languages' shares as priors, names the
    language, and score is its posterior. ``und`` with score 0 for a null text,
    one without letters, or where nothing could be learned. Of equal languages
    the first by name wins. lang, source and doc_id take no part in a prediction.
    bits_per_byte is null for ``und``. One row a row, repeated ones too. carry
    names columns of docs that the result holds too, in a struct ``carried``.

    Only the fitting shuffles, counts by language. The compiled models are
    broadcast: DENSE bytes of rows (one row a language at least), and for each
    further context of the sample, whose size is bounded, a few numbers.
    """
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast(fit(docs))

    def run(batches):
        model = models.value
        for batch in batches:
            texts = raw(batch.column("low"))
            known = [n for n, t in enumerate(texts) if t is not None] if model.langs else []
            pred, score, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if known:
                length, share = model.score([texts[n] for n in known])
                for k, n in enumerate(known):
                    best = int(share[k].argmax())
                    pred[n], score[n], bits[n] = model.langs[best], float(share[k, best]), float(length[k, best])
            found = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "bits_per_byte": pa.array(bits, pa.float64())}
            kept = {c: batch.column(c) for c in batch.schema.names if c != "low"}
            yield pa.RecordBatch.from_arrays([*kept.values(), *found.values()], [*kept, *found])

    low = F.when(F.col("text").rlike(r"\p{L}"), words("text")).alias("low")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = documents(docs, low, (bucket("doc_id", 4) == 2).alias("held_out"), *carried).drop("text")
    schema = StructType([*rows.drop("low").schema, *StructType.fromDDL("lang_pred string, score double, bits_per_byte double")])
    return rows.mapInArrow(run, schema)
