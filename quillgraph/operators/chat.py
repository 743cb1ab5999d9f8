"""Model calls over a table of requests: asked once a key, paced, retried, metered, within a budget."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.models import Pacer, retried
from quillgraph.runtime import materialize
from quillgraph.sources.manifest import Manifest

#: A chat function of this module: (system, user, schema) to (reply, tokens in, tokens out).
Call = Callable[[str, str, dict], tuple[str, int, int]]
CALLS = "key string, reply string, error string, tokens_in long, tokens_out long, usd double, tries int, paced_ms double"


class Passing(Exception):
    """A failure that may pass: too many requests, a server's error, a lost connection. All others aren't tried again."""


class ChatTable:
    """A cache of replies in a folder, and the calls that fill it.

    Requests are told apart by a digest of all that decides a reply. What the
    cache lacks is asked in rounds of ``round_keys``; a round's keys are dealt to ``lanes`` tasks, each with
    its share of the calls a minute and of the money that is left. A round is
    written before the next begins, so a job that dies asks one round again at
    most. Replies that are JSON are cached, whoever asked first.
    """

    def __init__(self, spark: SparkSession, folder: str, call: Call, model: str, schema: dict, version: str = "1", price: tuple[float, float] = (0.15, 0.6), per_minute: float = 600, lanes: int = 8, round_keys: int = 1000, tries: int = 6, sleep=time.sleep, **options):
        self.spark, self.folder, self.call, self.model, self.schema, self.version, self.price = spark, folder.rstrip("/"), call, model, schema, version, price
        self.per_minute, self.lanes, self.round_keys, self.tries, self.sleep = per_minute, lanes, round_keys, tries, sleep
        self.options = {k: v for k, v in sorted(options.items()) if v is not None}
        self.manifest = Manifest(spark, f"{self.folder}/states")

    def key(self, system: Column | str, user: Column | str) -> Column:
        """A digest of model, version, prompts and schema, and of the options that are set."""
        fixed = json.dumps([self.model, self.version, self.schema, *([self.options] if self.options else [])], sort_keys=True)
        return F.sha2(F.to_json(F.struct(F.lit(fixed).alias("fixed"), system, user)), 256)

    def calls(self) -> DataFrame:
        """Every call so far, failed ones too: key, reply, error, tokens_in, tokens_out, usd, tries, paced_ms."""
        paths = [f"{self.folder}/{p}" for p in self.manifest.latest()[1].get("parts", [])]
        return self.spark.read.schema(CALLS).parquet(*paths) if paths else self.spark.createDataFrame([], CALLS)

    def cache(self) -> DataFrame:
        """key, reply, one row a key."""
        return self.calls().filter("error is null").groupBy("key").agg(F.min("reply").alias("reply"))

    def meter(self) -> DataFrame:
        """One row: calls, failed, tokens_in, tokens_out, usd, paced_ms over all calls."""
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "usd", "paced_ms")]
        return self.calls().agg(F.count("*").alias("calls"), F.count("error").alias("failed"), *sums)

    def _ask(self, wanted: DataFrame, left: float) -> DataFrame:
        """The calls of a round, in as many tasks as there are lanes."""
        call, schema, price, tries, sleep, lanes = self.call, self.schema, self.price, self.tries, self.sleep, self.lanes
        share, rate = left / lanes, self.per_minute / lanes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pacer, spent = Pacer(rate, sleep=sleep), 0.0
            for rows in batches:
                out = []
                for key, system, user in zip(rows["key"], rows["system"], rows["user"]):
                    if spent >= share:
                        continue  # not asked: the budget stops it
                    before, tried, reply, error, a, b = pacer.waited, [], None, None, 0, 0

                    def once():
                        pacer.wait()
                        tried.append(1)
                        return call(system, user, schema)

                    try:
                        reply, a, b = retried(once, tries, sleep=sleep, passes=(), only=Passing)
                        json.loads(reply)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"[:300]
                    usd = (a * price[0] + b * price[1]) / 1e6
                    spent += usd
                    out.append((key, reply, error, a, b, usd, len(tried), 1000 * (pacer.waited - before)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLS.split(", ")])

        return wanted.repartition(lanes, "key").mapInPandas(run, CALLS)

    def replies(self, requests: DataFrame, budget: float = float("inf"), use_cache: bool = True) -> DataFrame:
        """requests(…, system, user) with reply, error and cached: one result a key, which equal requests share.

        error says why there is no reply; ``over_budget`` where none was asked,
        as ``budget`` US dollars of this run were spent: a task may go over its share by one call. Null prompts are empty.
        """
        rows = requests.withColumn("_key", self.key(F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))))
        keys = materialize(rows.groupBy(F.col("_key").alias("key")).agg(F.first(F.coalesce("system", F.lit(""))).alias("system"), F.first(F.coalesce("user", F.lit(""))).alias("user")), "keys", light=True)
        had = materialize(self.cache().join(keys.select("key"), "key", "left_semi"), "had", light=True) if use_cache else self.cache().limit(0)
        missing = materialize(keys.join(had.select("key"), "key", "left_anti"), "missing", light=True)
        rounds, spent, parts = -(-missing.count() // self.round_keys), 0.0, []
        for n in range(rounds):
            if spent >= budget:
                break
            name = f"calls-{uuid.uuid4().hex}"
            self._ask(missing.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == n), budget - spent).write.parquet(f"{self.folder}/{name}")
            number, state = self.manifest.latest()
            self.manifest.commit(number + 1, {"parts": [*state.get("parts", []), name]})
            parts.append(f"{self.folder}/{name}")
            spent += self.spark.read.schema(CALLS).parquet(parts[-1]).agg(F.coalesce(F.sum("usd"), F.lit(0.0))).first()[0]
        fresh = [self.spark.read.schema(CALLS).parquet(p).select("key", "reply", "error", F.lit(False).alias("cached")) for p in parts]
        found = reduce(DataFrame.unionByName, fresh, had.select("key", "reply", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")))
        joined = rows.join(found.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
        reply = F.when(F.col("error").isNull(), F.col("reply"))
        return joined.withColumns({"reply": reply, "error": F.when(F.col("cached").isNull(), "over_budget").otherwise(F.col("error")), "cached": F.coalesce("cached", F.lit(False))})
