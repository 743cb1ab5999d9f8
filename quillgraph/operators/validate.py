"""Relations against the vocabulary and their evidence; the first reason that fails is the reason."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import text as X
from quillgraph.runtime import if_small, materialize
from quillgraph.schemas import RISK_TOPICS

REASONS = ("unknown_endpoint", "self_loop", "type_signature", "evidence_not_found", "unknown_risk_topic")
#: Most neighbouring words by which a quotation is looked up, and letters of quotations that are broadcast as one automaton.
RUN, PATTERNS = 8, 2_000_000


def supported(evidence: Column | str, text: Column | str, strict: bool = False) -> Column:
    """Whether the text holds the evidence, white space and case aside. Empty evidence passes unless strict."""
    quote = X.squash(F.coalesce(F.col(evidence) if isinstance(evidence, str) else evidence, F.lit("")))
    held = F.contains(X.squash(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), quote)
    return held & (quote != "") if strict else held


def reasons(relations: DataFrame, vocabulary: DataFrame, topics=RISK_TOPICS, strict: bool = False) -> DataFrame:
    """relations(subject, subject_type, predicate, object, object_type, evidence, text) with ``reason``, null if kept.

    Types are those of the mentions, null for a surface that none has.
    """
    signature = vocabulary.select("predicate", F.col("subject_type").alias("_s"), F.col("object_type").alias("_o"))
    rows = relations.join(F.broadcast(signature), "predicate", "left")
    reason = (
        F.when(F.col("subject_type").isNull() | F.col("object_type").isNull(), REASONS[0])
        .when(F.col("subject") == F.col("object"), REASONS[1])
        .when(~(F.col("subject_type").eqNullSafe(F.col("_s")) & F.col("object_type").eqNullSafe(F.col("_o"))), REASONS[2])
        .when(~supported("evidence", "text", strict), REASONS[3])
        .when((F.col("object_type") == "RiskTopic") & ~F.col("object").isin(*topics), REASONS[4])
    )
    return rows.withColumn("reason", reason).drop("_s", "_o")


def with_types(extractions: DataFrame) -> DataFrame:
    """One row a relation of extractions(chunk_id, mentions, relations, …): its parts and the types of its ends.

    Of mentions with one name the last one's type holds.
    """
    place = F.posexplode("relations").alias("rel_ord", "r")

    def kind(name: Column) -> Column:
        found = F.filter("mentions", lambda m: m["name"] == name)
        return F.when(F.size(found) > 0, F.element_at(F.transform(found, lambda m: m["type"]), -1))

    rows = extractions.select(*[c for c in extractions.columns if c != "relations"], place)
    return rows.select("*", "r.*").withColumns({"subject_type": kind(F.col("r.subject")), "object_type": kind(F.col("r.object"))}).drop("r")


def dropped(rows: DataFrame) -> DataFrame:
    """reason, n, share of all rows; kept rows count as reason ``kept``."""
    counts = rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("reason", "n", F.round(F.try_divide("n", "total"), 6).alias("share"))


def _runs(words: Column, start: Column, n: int) -> Column:
    """The hash of n neighbouring words."""
    return F.xxhash64(F.lit(n), F.slice(words, start, F.lit(n)))


def _all_runs(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: _runs(words, i, n))).otherwise(F.array().cast("array<bigint>"))


def quoted(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """item_id, doc_id: which texts of docs(doc_id, text) hold which of quotes(item_id, text) whole, white space and case aside.

    Quotations of PATTERNS letters in all become one automaton, which is
    broadcast and passes over every text once. Of more, those of one or two words do, in as
    many automata as their letters fill; the others are looked up by a run of neighbouring
    words. A quotation's first and last word may be parts of a text's words, those
    between can't: of the runs of up to RUN words there, the one that the texts
    have least often is met by an equi-join of hashes, and only what
    that finds is compared. An empty quotation is in every text. Null
    texts and null ids have no part; repeated rows count as often as they occur.
    """
    d = docs.select("doc_id", X.squash("text").alias("whole")).filter("whole is not null and doc_id is not null")
    words = F.split("quote", " ")
    q = quotes.select("item_id", X.squash("text").alias("quote")).filter("quote is not null and item_id is not null")
    q = materialize(q.withColumn("between", F.least(F.size(words) - 2, F.lit(RUN))), "quotes")
    letters = q.select("quote", "between").distinct().agg(F.coalesce(F.sum(F.length("quote") + 1), F.lit(0)), F.coalesce(F.sum(F.when(F.col("between") <= 0, F.length("quote") + 1)), F.lit(0))).first()
    if letters[0] <= PATTERNS:
        return _scanned(d, q, 1)
    return _scanned(d, q.filter("between <= 0"), -(-letters[1] // PATTERNS)).unionByName(_by_runs(d, q.filter("between > 0")))


#: The automaton that this worker made last.
_MADE: dict[str, tuple] = {}


def _automaton(key: str, quotes: list[str]) -> tuple:
    """(automaton, what is in every text) of some quotations, made once a worker."""
    import ahocorasick

    if key not in _MADE:
        automaton = ahocorasick.Automaton()
        for quote in quotes:
            if quote:
                automaton.add_word(quote, quote)
        automaton.make_automaton()
        _MADE.clear()
        _MADE[key] = automaton, [q for q in quotes if not q]
    return _MADE[key]


def _scanned(d: DataFrame, q: DataFrame, groups: int) -> DataFrame:
    """Quotations found by automata, ``groups`` of them, each of about PATTERNS letters and a pass over the texts."""
    spark = d.sparkSession
    found = spark.createDataFrame([], T.StructType([q.schema["item_id"], d.schema["doc_id"]]))
    schema = T.StructType([d.schema["doc_id"], T.StructField("quote", T.StringType())])
    for n in range(groups):
        own = q.select("quote").distinct().filter(F.pmod(F.xxhash64("quote"), F.lit(groups)) == n).toArrow().column("quote").to_pylist()  # about PATTERNS letters
        shared = spark.sparkContext.broadcast(sorted(own))

        key = uuid.uuid4().hex

        def scan(batches):
            automaton, always = _automaton(key, shared.value)
            for batch in batches:
                places, held = [], []
                for k, text in enumerate(batch.column("whole").to_pylist()):
                    seen = {*always, *(quote for _, quote in automaton.iter(text))} if len(automaton) else set(always)
                    places += [k] * len(seen)
                    held += seen
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(places, pa.int64())), pa.array(held, pa.string())], ["doc_id", "quote"])

        if own:
            found = found.unionByName(d.mapInArrow(scan, schema).join(q.select("item_id", "quote"), "quote").select("item_id", "doc_id"))
    return found


def _by_runs(d: DataFrame, q: DataFrame) -> DataFrame:
    """Quotations of three words or more, found by the rarest of their inner runs."""
    lengths = [r.between for r in q.select("between").distinct().collect()]  # RUN at most
    if not lengths:
        return d.sparkSession.createDataFrame([], T.StructType([q.schema["item_id"], d.schema["doc_id"]]))
    words = F.split("quote", " ")
    inner = F.slice(words, F.lit(2), F.size(words) - 2)
    runs = F.array().cast("array<bigint>")
    for n in lengths:
        runs = F.when(F.col("between") == n, _all_runs(inner, n)).otherwise(runs)
    asked = materialize(q.select("item_id", "quote", F.explode(F.array_distinct(runs)).alias("run")), "runs", light=True)
    # the texts' runs that any quotation has, and how many texts have each: a filter before the shuffle where the quotations' runs are few
    wanted = asked.select("run").distinct()
    own = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split("whole", " ").alias("w"))
    own = own.select("row", "doc_id", F.explode(F.array_distinct(F.concat(*[_all_runs(F.col("w"), n) for n in lengths]))).alias("run"))
    own = materialize(own.join(if_small(materialize(wanted, "wanted", light=True)), "run", "left_semi"), "met", light=True)
    counts = own.groupBy("run").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "run", "left").groupBy("item_id", "quote").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"), F.count_if(F.col("n").isNull()).alias("unmet"))
    chosen = rarest.filter("unmet = 0").select("item_id", "quote", "run")  # a run that no text has: no text has the quotation
    pairs = own.join(chosen, "run").select("doc_id", "item_id", "quote").distinct()
    times = q.groupBy("item_id", "quote").agg(F.count("*").alias("times"))
    held = pairs.join(d, "doc_id").filter(F.contains("whole", "quote")).select("item_id", "doc_id", "quote")
    return held.join(times, ["item_id", "quote"]).select("item_id", "doc_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("item_id", "doc_id")
