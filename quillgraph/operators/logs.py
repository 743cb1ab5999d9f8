"""Append-only logs: the last row of a key decides, and may itself be stale."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay(log: DataFrame, keys: list[str], order: list[str], stale: Column) -> DataFrame:
    """The last row of each key by order, unless it is stale: then the key has none.

    Ranking comes before the filter; the other way round an older row that a
    stale one evicted would come back.
    """
    fields = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return last.filter(~F.coalesce(stale, F.lit(False)))


def fingerprint(*parts, size: int = 12, **options) -> str:
    """Hex digest of a prompt, its schema and the options that are set."""
    spec = [*parts, *([{k: v for k, v in sorted(options.items()) if v is not None}] if any(v is not None for v in options.values()) else [])]
    return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:size]


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done; a stage that is run again goes on from here."""
    return rows.join(done.select(key), key, "left_anti")


def require_all(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows, after a check that known has every key."""
    absent = rows.select(key).join(known.select(key), key, "left_anti").distinct().limit(5).collect()
    if absent:
        raise ValueError(f"unknown {key}: {[r[0] for r in absent]}")
    return rows
