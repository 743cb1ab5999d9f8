"""The replay of an append-only log as a stream: keyed state holds each key's latest row, stale ones included."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State stores that processors with several variables and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _rank(values) -> tuple:
    """Comparable; what is missing comes first, as nulls do."""
    return tuple((False, 0) if v is None or v != v else (True, v) for v in values)


class _Latest(StatefulProcessor):
    """State of a key: the order, payload and staleness of its latest row.

    A stale row is kept like any other, so that an older row that arrives later
    doesn't come back; ``keep`` milliseconds after it was last seen its key is
    forgotten.
    """

    def __init__(self, keys: list[str], order: T.StructType, keep: int | None):
        self.keys, self.order, self.keep = keys, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", T.StructType([*self.order.fields, T.StructField("payload", T.StringType()), T.StructField("stale", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in self.order.fields]
        held = tuple(self.row.get()) if self.row.exists() else None
        best = held
        for frame in rows:
            for row in frame[[*names, "payload", "stale"]].itertuples(index=False, name=None):
                row = tuple(v.item() if hasattr(v, "item") else v for v in row)
                row = tuple(None if v is None or v != v else v for v in row[: len(names)]) + row[len(names) :]
                if best is None or _rank(row[: len(names)]) >= _rank(best[: len(names)]):
                    best = row
        if best is not held:
            self.row.update((*best[:-1], bool(best[-1])))
            if self.keep is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if best[-1]:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)
            yield pd.DataFrame([(*key, best[-2], bool(best[-1]))], columns=[*self.keys, "payload", "evicted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.row.exists() and self.row.get()[-1]:
            self.row.clear()
        return iter([])

    def close(self) -> None:
        pass


def superseded(log: DataFrame, keys: list[str], order: list[str], stale: Column, keep: int | None = None) -> DataFrame:
    """keys, payload, evicted: what changes in the replay of a log that streams in, as `logs.replay` has it for a finished one.

    A key's latest row by order counts, in whatever order rows arrive; of equal
    orders the later arrival. Each change of a key's latest row is one row:
    payload is the row's other fields as JSON, evicted says that it is stale, so
    the key has none. In update mode, keys as strings or numbers. keep:
    milliseconds after which the state of an evicted key may be forgotten; then
    an older row that comes later still would count. Needs PROVIDER as the
    session's state store.
    """
    fields = [c for c in log.columns if c not in keys]
    kinds = {f.name: f.dataType for f in log.schema.fields}
    plain = lambda c: F.unix_micros(c) if isinstance(kinds[c], T.TimestampType) else F.col(c)
    rows = log.select(*keys, *[plain(c).alias(f"order__{n}") for n, c in enumerate(order)], F.to_json(F.struct(*fields), _STAMP).alias("payload"), F.coalesce(stale, F.lit(False)).alias("stale"))
    if keep is None:
        return _by_aggregate(rows, keys, [f"order__{n}" for n in range(len(order))])
    state = T.StructType([rows.schema[f"order__{n}"] for n in range(len(order))])
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("payload", T.StringType()), T.StructField("evicted", T.BooleanType())])
    return rows.groupBy(*keys).transformWithStateInPandas(_Latest(keys, state, keep), out, "Update", "ProcessingTime")


def _by_aggregate(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What `_Latest` gives where no key is forgotten, by an aggregation: its state takes no message a key to and from Python.

    The time of a micro-batch is a row's last order, so that of equal orders the
    later arrival counts, and tells whether a key's latest row came with this batch.
    """
    known = lambda c: F.when(~F.isnan(c), F.col(c)) if isinstance(rows.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)
    timed = rows.withColumn("arrived", F.current_timestamp())
    last = timed.groupBy(*keys).agg(F.max_by(F.struct("payload", "stale", "arrived"), F.struct(*[known(c).alias(c) for c in order], "arrived")).alias("last"))
    changed = last.filter(F.col("last.arrived") == F.current_timestamp())
    return changed.select(*keys, F.col("last.payload").alias("payload"), F.col("last.stale").alias("evicted"))


def current(changes: DataFrame, keys: list[str], number: str, log_schema: T.StructType) -> DataFrame:
    """The rows that hold after all changes(keys, payload, evicted, number): each key's last change by number, unless it evicts."""
    last = Window.partitionBy(*keys).orderBy(F.desc(number))
    kept = changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1 and not evicted")
    fields = T.StructType([f for f in log_schema.fields if f.name not in keys])
    return kept.select(*keys, F.from_json("payload", fields, _STAMP).alias("r")).select(*keys, "r.*")
