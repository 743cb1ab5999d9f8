"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

DataFrame and SQL expressions only. A text's words become 64-bit hashes once;
windows, n-grams and repetition are computed from those within the row, so
nothing is exploded but for the n-gram counts, which are summed before any
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import documents
from quillgraph.runtime import if_small, materialize

#: Buckets of hashed n-grams, and what is added to each one's counts.
BUCKETS, SMOOTH = 1 << 16, 0.5
#: Grams of no weight that are added to each text, so that a short one isn't judged by a few.
PRIOR = 40
#: Standard deviations below the mean of trusted texts at which a text is rejected.
DEVIATIONS = 4.0

HASHES = r"transform(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), w -> xxhash64(w))"
SINGLES = f"transform(hashes, h -> int(pmod(h, {BUCKETS})))"
PAIRS = f"if(size(hashes) < 2, cast(array() as array<int>), transform(sequence(1, size(hashes) - 1), i -> int(pmod(xxhash64(hashes[i - 1], hashes[i]), {BUCKETS}))))"
WINDOWS = "if(size(hashes) < 5, cast(array() as array<bigint>), transform(sequence(0, size(hashes) - 5), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2], hashes[i + 3], hashes[i + 4])))"
#: Windows in order of hash and place, for the texts in which some are equal.
TWICE = "if(size(array_distinct(windows)) < size(windows), sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))), null)"
#: Places of the windows that have an equal, in order.
PLACES = "sort_array(transform(filter(twice, (x, k) -> coalesce(x.h = get(twice, k - 1).h, false) or coalesce(x.h = get(twice, k + 1).h, false)), x -> x.i))"
#: Each covers the words up to the next one, at most its own five.
COVERED = "coalesce(aggregate(transform(places, (p, k) -> least(5, coalesce(get(places, k + 1) - p, 5))), 0L, (a, x) -> a + x), 0L)"


def _hashed(docs: DataFrame, *more: Column) -> DataFrame:
    rows = documents(docs, *more)
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *rows.columns[2:]).withColumn("hashes", F.expr(HASHES))


def trusted_rows(labels: DataFrame) -> DataFrame:
    """doc_id, role of every row of labels(doc_id, quality) with quality 1: by a hash, half of them are to 'fit' and half to 'hold'."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.select("doc_id", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, "fit").otherwise("hold").alias("role"))


def _weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: the log-likelihood ratio of each bucket between the trusted rows and all rows."""
    fit = trusted.filter("role = 'fit'").select("doc_id", F.lit(True).alias("target"))
    counts = (
        _hashed(docs)
        .select("doc_id", "hashes")
        .join(if_small(fit), "doc_id", "left")
        .select("target", F.explode(F.expr(f"concat({SINGLES}, {PAIRS})")).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    )
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    rows = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("b"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    ratio = f"float(ln((x.target + {SMOOTH}) / (all_target + {SMOOTH * BUCKETS})) - ln((x.raw + {SMOOTH}) / (all_raw + {SMOOTH * BUCKETS})))"
    return materialize(rows.select(F.expr(f"transform(b, x -> if(all_target = 0, float(0), {ratio}))").alias("weights")), "weights")


def _scored(docs: DataFrame, weights: DataFrame) -> DataFrame:
    docs = docs.withColumn("weights", weights.scalar())
    total = f"""aggregate(sequence(0, size(hashes) - 1), 0D, (s, i) -> s + weights[int(pmod(hashes[i], {BUCKETS}))]
        + if(i = 0, 0D, weights[int(pmod(xxhash64(hashes[i - 1], hashes[i]), {BUCKETS}))]))"""
    grams = f"(2 * size(hashes) - 1 + {PRIOR})"
    return docs.withColumn("llr", F.expr(f"if(size(hashes) = 0, 0D, round({total} / {grams}, 9))")).drop("weights")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(weights, threshold) from all rows of docs and all of those that labels trust.

    Half of the trusted rows give the target's counts; the threshold is DEVIATIONS
    standard deviations below the mean score of the other half. Without trusted
    rows nothing is rejected by it.
    """
    trusted = materialize(trusted_rows(labels), "trusted")
    weights = _weights(docs, trusted)
    held = _hashed(docs.join(if_small(trusted.filter("role = 'hold'").select(F.col("doc_id"))), "doc_id", "left_semi"))
    mean, spread = _scored(held, weights).agg(F.avg("llr"), F.stddev_pop("llr")).first()
    return weights, float("-inf") if mean is None else mean - DEVIATIONS * spread


def judge(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of docs(doc_id, text) judged; carry names columns of docs that the result holds too, in a struct ``carried``.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr, kept. base_failed: under 10 words, or over a fifth of them
    in repeated five-word windows. llr: the sum of the log-likelihood ratios of
    a text's words and word pairs, divided by their number and PRIOR. A null or
    empty text has no words and fails. Repeated rows are judged alike.
    """
    weights, threshold = fit(docs, labels)
    text = F.col("text")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = _hashed(docs, *carried).select(
        "doc_id",
        *["carried" for _ in carried],
        "hashes",
        F.size("hashes").cast("long").alias("n_words"),
        (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    for name, of in (("windows", WINDOWS), ("twice", TWICE), ("places", PLACES), ("n_repeat_words", COVERED)):
        rows = rows.withColumn(name, F.expr(of))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = _scored(rows, weights).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))
    # An id makes the verdict one that Spark doesn't move: a filter on it would else be pushed down with all of these expressions in it, many times over.
    kept = kept & (F.monotonically_increasing_id() >= 0)
    return rows.select("doc_id", *["carried" for _ in carried], "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("n_repeat_words").cast("long").alias("n_repeat_words"), "base_failed", "llr", kept.alias("kept"))
