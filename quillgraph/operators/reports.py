"""Reports over logs and what is shown to a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.context import budget_prefix
from quillgraph.schemas import DEFINITIONS, ENTITY_TYPES, RELATIONS, RISK_TOPICS


def vocabulary_block(relations=RELATIONS, types=ENTITY_TYPES, topics=RISK_TOPICS) -> str:
    """The vocabulary as text for a prompt."""
    lines = ["Entity types: " + ", ".join(types), "Relations:"]
    lines += [f"- {name} ({subject} -> {object_})" + (f": {DEFINITIONS[name]}" if name in DEFINITIONS else "") for name, subject, object_, *_ in relations]
    return "\n".join([*lines, "Risk topics: " + "; ".join(topics)])


def chunk_prompt(company: Column | str, section: Column | str, date: Column | str, text: Column | str) -> Column:
    """A passage with where it comes from."""
    return F.concat_ws("\n", F.concat(F.lit("Filer: "), company), F.concat(F.lit("Section: "), section), F.concat(F.lit("Filed: "), F.col(date).cast("string") if isinstance(date, str) else date.cast("string")), F.lit(""), text)


def evidence(questions: DataFrame, passages: DataFrame, most: int = 12, chars: int = 48_000) -> DataFrame:
    """qid, reference: what a judge may rely on, from questions(qid, gold_chunk_ids, expected_answers, expected_count) and passages(chunk_id, text).

    The known count and answers, then whole gold passages in order of their ids,
    at most ``most`` and within ``chars``, and how many were left out.
    """
    gold = questions.select("qid", F.posexplode(F.array_sort("gold_chunk_ids")).alias("pos", "chunk_id")).join(passages.select("chunk_id", "text"), "chunk_id")
    shown = budget_prefix(gold, ["qid"], ["pos"], F.length("text"), chars)
    text = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "text"))), 1, most), lambda x: F.concat(F.lit("["), x["chunk_id"], F.lit("]\n"), x["text"])), "\n\n")
    blocks = shown.groupBy("qid").agg(text.alias("passages"), F.least(F.count("*"), F.lit(most)).alias("n"))
    rows = questions.join(blocks, "qid", "left")
    left_out = F.size("gold_chunk_ids") - F.coalesce("n", F.lit(0))
    parts = (
        F.when(F.col("expected_count").isNotNull(), F.concat(F.lit("Exact count: "), F.col("expected_count").cast("string"))),
        F.when(F.size("expected_answers") > 0, F.concat(F.lit("Known answers: "), F.array_join("expected_answers", "; "))),
        F.col("passages"),
        F.when(left_out > 0, F.concat(F.lit("Passages left out: "), left_out.cast("string"))),
    )
    return rows.select("qid", F.concat_ws("\n\n", *parts).alias("reference"))


def absent(questions: DataFrame, log: DataFrame) -> DataFrame:
    """qid of the questions that have no log row."""
    return questions.join(log.select("qid"), "qid", "left_anti").select("qid").distinct()


def complete(questions: DataFrame, log: DataFrame) -> DataFrame:
    """questions with their log rows; raises if any question has none, and names the first of them."""
    lost = absent(questions, log).orderBy("qid").limit(5).collect()
    if lost:
        raise ValueError(f"no row for {[r.qid for r in lost]}")
    return questions.join(log, "qid")


def misses(scored: DataFrame) -> DataFrame:
    """qid, verdict, question and the start of the reason of what isn't correct."""
    return scored.filter("verdict <> 'correct'").select("qid", "verdict", "question", F.substring("reason", 1, 80).alias("reason"))


def agreement(scored: DataFrame) -> DataFrame:
    """One row over scored(qid, key, verdict): keyed, agree, and the ids that the judge rescued or overrode."""
    right = F.col("verdict") == "correct"
    keyed = scored.filter("key is not null")
    ids = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("qid"))))
    return keyed.agg(F.count("*").alias("keyed"), F.count_if((F.col("key") == 1) == right).alias("agree"), ids((F.col("key") == 0) & right).alias("rescued"), ids((F.col("key") == 1) & ~right).alias("overridden"))


def refusals(answers: DataFrame) -> DataFrame:
    """stratum, refused, fallbacks over answers(strata, answerable, fallback)."""
    rows = answers.select(F.explode("strata").alias("stratum"), "answerable", "fallback")
    return rows.groupBy("stratum").agg(F.count_if(~F.col("answerable")).alias("refused"), F.count_if("fallback").alias("fallbacks"))


def billed(answers: DataFrame) -> DataFrame:
    """One row over answers(usd, latency_ms, answerable): figures of rows that cost money; the rest is counted apart."""
    paid = F.col("usd") > 0
    return answers.agg(
        F.count_if(paid).alias("billed"),
        F.count_if(~paid & ~F.col("answerable")).alias("free_refusals"),
        F.count_if(~paid & F.col("answerable")).alias("cached"),
        F.median(F.when(paid, F.col("latency_ms"))).alias("median_ms"),
        F.round(F.avg(F.when(paid, F.col("usd"))), 6).alias("mean_usd"),
    )


def projected_usd(probe_usd: float, probe_rows: int, remaining: int) -> float:
    """What the remaining rows will cost at a probe's rate."""
    return 0.0 if probe_rows == 0 else probe_usd / probe_rows * remaining


def embedding_usd(texts: DataFrame, column: str, usd_per_million: float) -> float:
    """What embedding all texts will cost, at four characters a token."""
    tokens = texts.agg(F.coalesce(F.sum(F.floor(F.length(column) / 4)), F.lit(0))).first()[0]
    return tokens * usd_per_million / 1e6


def by_kind(rows: DataFrame, kind: Column, name: str = "kind") -> DataFrame:
    """kind, n, the most frequent first."""
    return rows.groupBy(kind.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
