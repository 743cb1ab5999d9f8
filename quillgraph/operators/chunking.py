"""Documents to overlapping chunks with ids that their content's place fixes."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.runtime import short_batches

TARGET, OVERLAP, MIN_CHARS, MAX_DIGITS = 4000, 800, 300, 0.25


def _runs(text: str, target: int, step: int) -> Iterator[tuple[list[str], list[str]]]:
    """(heads, pieces): full-length heads of a paragraph over target, then the pieces up to the next such paragraph, its own rest first."""
    heads: list[str] = []
    pieces: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text):
        if not paragraph or paragraph.isspace():
            continue
        cuts = max(0, -((target - len(paragraph)) // step))
        if cuts:
            yield heads, pieces
            heads, pieces = [paragraph[k * step : k * step + target] for k in range(cuts)], []
        pieces.append(paragraph[cuts * step :])
    yield heads, pieces


def split(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Chunks of about target characters that share the last ``overlap`` of the one before.

    Paragraphs, as they are between blank lines, are kept whole where they fit.
    One longer than target is cut into heads of target characters, each
    beginning overlap before the last one's end; nothing is carried over to them.
    Of the pieces between, each chunk takes as many as the sums of their lengths
    allow (a gap counts two), after the end of the chunk before, and one at least.
    """
    chunks: list[str] = []
    for heads, pieces in _runs(text, target, target - overlap):
        chunks += heads
        # reach[k]: the length of pieces 0 to k with their gaps, but for the last one's
        reach = [total - 2 for total in accumulate(len(x) + 2 for x in pieces)]
        first, tail = 0, ""
        while first < len(pieces):
            room = target - len(tail) + (reach[first - 1] + 2 if first else 0)
            after = max(first + 1, bisect_right(reach, room))
            chunk = "\n\n".join(([tail] if first else []) + pieces[first:after])
            chunks.append(chunk)
            first, tail = after, chunk[-overlap:]
    return chunks


def chunk(docs: DataFrame, keys: list[str], text: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Rows of docs by chunk: chunk_id from keys and ordinal, ordinal from 0, and the chunk as text.

    Ordinals count all chunks; filters come after. The fold over paragraphs runs
    in Arrow batches; ids and the rest are expressions.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split(t, target, overlap) if t else [])

    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.posexplode(pieces(F.col(text))).alias("ordinal", text))
    return rows.withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("chunk_id", X.digest(*[F.col(k).cast("string") for k in keys], F.col("ordinal").cast("string")))


def keep(text: Column | str, proxy: Column) -> Column:
    """Long enough; and of proxies, only what states board service and isn't mostly figures."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.length(text) >= MIN_CHARS) & (~proxy | (text.rlike(X.BOARD) & (X.digit_density(text) < MAX_DIGITS)))


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; empty where they identify rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
