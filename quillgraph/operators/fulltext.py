"""An inverted index over short texts: BM25, and the best text of each question without reading common words' lists whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.runtime import materialize
from quillgraph.sources.manifest import Manifest

#: BM25: how soon a repeated word stops to count, and how much long texts lose.
K1, B = 1.2, 0.75
#: Levels that a word's postings are dealt into by their weight.
LEVELS = 16
#: Words up to which a search names them to the reader of the postings' files.
FEW = 500
#: Digits that scores are compared by.
DIGITS = 9


class Inverted:
    """Postings of texts(id, words array) in a folder.

    Texts of the same words are one: it has the smallest of their ids, as no other
    of them can be the best, and counts as often as they are.

    postings: word, level, id, size, weight - the share that the word gives the
    text's score; level says in which LEVELS-th of the word's greatest weight it
    lies. words: word, df, most (its greatest weight) and first, the text that
    has it: of equal ones the shortest, then the smallest id. The state names one whole build, so a rebuild is
    switched to at once and readers keep theirs.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        number, state = Manifest(spark, f"{self.folder}/states").latest()
        if number < 0:
            raise FileNotFoundError(f"no index in {folder}")
        self.texts, self.average = state["texts"], state["average"]
        self.postings, self.words = (spark.read.parquet(f"{self.folder}/{name}-{number}") for name in ("postings", "words"))

    @staticmethod
    def build(texts: DataFrame, folder: str) -> Inverted:
        """Index texts(id, words): null and empty ones have no part, repeated ids are several texts."""
        spark, folder = texts.sparkSession, folder.rstrip("/")
        rows = texts.select("id", "words").filter("id is not null and size(words) > 0").withColumn("size", F.size("words"))
        total = rows.agg(F.count("*"), F.avg("size")).first()
        n, average = total[0], total[1] or 1.0
        same = rows.groupBy(F.sort_array("words").alias("words"), "size").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        counted = same.select("id", "size", "copies", F.explode("words").alias("word")).groupBy("id", "size", "copies", "word").agg(F.count("*").alias("tf"))
        counted = materialize(counted, "counted", light=True)
        df = counted.groupBy("word").agg(F.sum("copies").alias("df"))
        weight = F.round(F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / average)), DIGITS)
        weighed = materialize(counted.join(df, "word").select("word", "df", "id", "size", weight.alias("weight")), "weighed", light=True)
        first = F.min_by("id", F.struct(-F.col("weight"), F.col("size"), F.col("id")))
        words = weighed.groupBy("word").agg(F.first("df").alias("df"), F.max("weight").alias("most"), first.alias("first"))
        manifest = Manifest(spark, f"{folder}/states")
        number = manifest.latest()[0] + 1
        words.write.mode("overwrite").parquet(f"{folder}/words-{number}")
        level = F.least(F.lit(LEVELS - 1), F.floor(F.lit(LEVELS) * F.col("weight") / F.col("most")).cast("int"))
        postings = weighed.join(spark.read.parquet(f"{folder}/words-{number}").select("word", "most"), "word").select("word", level.alias("level"), "id", "size", "weight")
        # heavy postings of a word lie apart from its many light ones, and readers skip files by word and level
        postings.repartitionByRange("word", "level", "id").sortWithinPartitions("word", "level", "id").write.mode("overwrite").parquet(f"{folder}/postings-{number}")
        manifest.commit(number, {"texts": n, "average": average})
        return Inverted(spark, folder)

    def _lists(self, asked: DataFrame) -> DataFrame:
        """Postings; of few words only those files that hold them."""
        few = [r.word for r in asked.select("word").distinct().limit(FEW + 1).collect()]
        return self.postings.filter(F.col("word").isin(few)) if len(few) <= FEW else self.postings

    def _scores(self, pairs: DataFrame, asked: DataFrame, lists: DataFrame) -> DataFrame:
        """q, id, size, score of pairs(q, id): all words of a question that a text has."""
        found = pairs.join(asked.select("q", "word"), "q").join(lists.select("word", "id", "size", "weight"), ["word", "id"])
        return found.groupBy("q", "id").agg(F.first("size").alias("size"), _sum("weight").alias("score"))

    def best(self, asked: DataFrame) -> DataFrame:
        """q, id, score: the text with the highest BM25 score for each of asked(q, words); of equal ones the shorter, then the smaller id.

        Each word of a question counts once; questions that share no word with any text have no row.
        Exact, and common words' postings aren't met whole: the texts in which a
        question's words weigh most give a score that the best one reaches. Words
        whose greatest weights together stay below that can't find a better text,
        and neither can a light posting of a word that the greatest weights of
        all others don't lift that far. What is left is met by word and level.
        Questions of the same words are searched for once.
        """
        every = asked.filter("q is not null").groupBy("q").agg(F.sort_array(F.array_compact(F.array_distinct(F.flatten(F.collect_list("words"))))).alias("words"))
        every = materialize(every, "questions", light=True)
        alike = materialize(every.groupBy("words").agg(F.min("q").alias("first")), "alike", light=True)
        best = self._best(alike.select(F.col("first").alias("q"), F.explode("words").alias("word")))
        return every.join(alike.join(best, F.col("first") == F.col("q")).select("words", "id", "score"), "words").select("q", "id", "score")

    def _best(self, asked: DataFrame) -> DataFrame:
        """The rows of `best` for the different questions of asked(q, word)."""
        words = materialize(asked.join(self.words, "word"), "asked", light=True)
        lists = self._lists(words)
        lead = self._scores(words.select("q", F.col("first").alias("id")).distinct(), words, lists)
        reached = lead.groupBy("q").agg(F.max("score").alias("reached"))
        own = words.join(reached, "q")
        lighter = Window.partitionBy("q").orderBy("most", "word")  # of one question's words
        all_most = F.sum(F.col("most").cast(f"decimal(28,{DIGITS})")).over(Window.partitionBy("q")).cast("double")
        bounded = own.withColumns({"up_to": F.sum(F.col("most").cast(f"decimal(28,{DIGITS})")).over(lighter.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), "others": F.round(all_most - F.col("most"), DIGITS)})
        slack = 10.0**-DIGITS * 64  # what rounding may have taken from a sum
        needed = bounded.filter(F.col("up_to") >= F.col("reached") - slack)
        floor = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(F.lit(LEVELS) * (F.col("reached") - F.col("others") - slack) / F.col("most")).cast("int")))
        met = needed.select("q", "word", F.explode(F.sequence(floor, F.lit(LEVELS - 1))).alias("level"))
        pairs = met.join(lists.select("word", "level", "id"), ["word", "level"]).select("q", "id").distinct()
        scores = self._scores(pairs, words, lists)
        order = F.struct(-F.col("score"), F.col("size"), F.col("id"))
        return scores.groupBy("q").agg(F.min_by(F.struct("id", "score"), order).alias("top")).select("q", "top.id", "top.score")


def _sum(column: str) -> Column:
    """A sum that doesn't hang on the order of its terms, as weights have DIGITS digits."""
    return F.sum(F.col(column).cast(f"decimal(28,{DIGITS})")).cast("double")
