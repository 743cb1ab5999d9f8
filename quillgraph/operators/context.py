"""Facts as sentences, context with the ids that it shows, and checks of citations against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X

FACTS, PER_FACT, AGGREGATES, PASSAGES = 20, 3, 12, 10


def verbalise(steps: DataFrame, vocabulary: DataFrame, by: list[str], most: int = FACTS) -> DataFrame:
    """by, text, chunk_ids, support, path from steps(…by, path, hop, subject, predicate, object, chunk_ids, support).

    A path is its hops' sentences joined by arrows. Citations begin with one id
    of each hop. Support is that of the weakest hop. Equal texts keep the best
    ranked path.
    """
    said = steps.join(F.broadcast(vocabulary.select("predicate", "phrase")), "predicate").withColumn("said", F.concat_ws(" ", "subject", "phrase", "object"))
    hops = F.sort_array(F.collect_list(F.struct("hop", "said", "chunk_ids", "support")))
    rows = said.groupBy(*by, "path").agg(hops.alias("h"))
    leading = F.array_compact(F.transform("h", lambda x: F.get(x["chunk_ids"], F.lit(0))))
    rest = F.flatten(F.transform("h", lambda x: x["chunk_ids"]))
    rows = rows.select(*by, "path", F.array_join(F.transform("h", lambda x: x["said"]), " → ").alias("text"), F.array_distinct(F.concat(leading, rest)).alias("chunk_ids"), F.array_min(F.transform("h", lambda x: x["support"])).alias("support"))
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "text").orderBy("path"))).filter("_n = 1").drop("_n")
    ranked = best.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("path") if by else Window.orderBy("path")))
    return ranked.filter(F.col("_n") <= most).drop("_n")


def aggregate_text(anchor: Column | str, outbound: Column, phrase: Column | str, object_type: Column | str, noun: Column | str, n: Column, examples: Column) -> Column:
    """A count as a sentence with examples, and how many there are besides."""
    head = F.when(outbound, F.concat_ws(" ", anchor, phrase, F.concat(F.lit(""), n.cast("string")), F.concat(F.lit("distinct "), X.plural(object_type)))).otherwise(F.concat_ws(" ", anchor, F.lit("has"), n.cast("string"), noun))
    more = F.when(n > F.size(examples), F.concat(F.lit("; and "), (n - F.size(examples)).cast("string"), F.lit(" others"))).otherwise("")
    return F.concat(head, F.lit(": "), F.array_join(examples, "; "), more)


def verbalise_aggregates(counts: DataFrame, vocabulary: DataFrame, most: int = AGGREGATES) -> DataFrame:
    """anchor, text, n, chunk_ids of counts(anchor, anchor_name, predicate, outbound, n, examples, chunk_ids); single neighbours are no count."""
    rows = counts.filter("n >= 2").join(F.broadcast(vocabulary), "predicate")
    text = aggregate_text("anchor_name", F.col("outbound"), "phrase", "object_type", "noun", F.col("n"), F.col("examples"))
    w = Window.partitionBy("anchor").orderBy(F.desc("n"), "predicate", F.desc("outbound"))
    return rows.withColumn("text", text).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most).select("anchor", "rank", "text", "n", "chunk_ids")


def build_context(facts: Column, aggregates: Column, passages: Column) -> tuple[Column, Column]:
    """(text, ids that it shows) of arrays of facts and aggregates (text, chunk_ids) and passages (chunk_id, text).

    A fact shows its first PER_FACT ids; only what is shown may be cited.
    """

    def line(x: Column) -> Column:
        return F.concat(F.lit("- "), x["text"], F.lit(" ["), F.array_join(F.slice(x["chunk_ids"], 1, PER_FACT), ", "), F.lit("]"))

    def block(title: str, rows: Column, each) -> Column:
        return F.when(F.size(rows) > 0, F.concat(F.lit(title + "\n"), F.array_join(F.transform(rows, each), "\n")))

    shown = F.slice(passages, 1, PASSAGES)
    text = F.concat_ws("\n\n", block("Counts", aggregates, line), block("Facts", facts, line), block("Passages", shown, lambda p: F.concat(F.lit("["), p["chunk_id"], F.lit("]\n"), p["text"])))
    cited = [F.flatten(F.transform(x, lambda r: F.slice(r["chunk_ids"], 1, PER_FACT))) for x in (aggregates, facts)]
    return text, F.array_distinct(F.concat(*cited, F.transform(shown, lambda p: p["chunk_id"])))


def cleaned(citations: Column | str) -> Column:
    return F.transform(citations, X.bare_citation)


def invented(citations: Column | str, valid: Column | str) -> Column:
    """Cited ids that weren't shown, ascending."""
    return F.array_sort(F.array_except(cleaned(citations), valid))


def publishable(citations: Column | str, valid: Column | str) -> Column:
    """At least one citation, and none that wasn't shown."""
    return (F.size(citations) > 0) & (F.size(invented(citations, valid)) == 0)


def budget_prefix(rows: DataFrame, by: list[str], order: list, size: Column, most: int) -> DataFrame:
    """The first rows of each group whose sizes sum to at most ``most``; the first overflow ends it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= most)
