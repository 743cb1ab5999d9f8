"""Filing sections: the newest filings of each kind, flattened to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X

# How many of each form, and the items that are read.
NEWEST = {"10-K": 1, "DEF 14A": 1, "8-K": 8}
ANNUAL_ITEMS = ("Item 1", "Item 1A", "Item 3", "Item 7")
CURRENT_ITEMS = ("Item 1.01", "Item 2.01", "Item 5.02")
MIN_CHARS = 200


def newest(filings: DataFrame, counts: dict[str, int] = NEWEST) -> DataFrame:
    """The newest filings of each ticker and form, by date, then accession."""
    most: Column = F.lit(None).cast("int")
    for form, n in counts.items():
        most = F.when(F.col("form") == form, n).otherwise(most)
    order = Window.partitionBy("ticker", "form").orderBy(F.desc("filing_date"), F.desc("accession"))
    return filings.filter(F.col("form").isin(*counts)).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")


def pinned(filings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Only the accessions that a manifest(ticker, accessions) lists, where it lists the ticker."""
    listed = manifest.select("ticker", F.explode("accessions").alias("accession"))
    unlisted = filings.join(manifest.select("ticker"), "ticker", "left_anti")
    return filings.join(listed, ["ticker", "accession"], "left_semi").unionByName(unlisted)


def not_done(filings: DataFrame, done: DataFrame) -> DataFrame:
    """Filings of tickers that no row of done has."""
    return filings.join(done.select("ticker"), "ticker", "left_anti")


def flatten(filings: DataFrame) -> DataFrame:
    """One document a section of filings(…, sections map<string, string>, exhibits array<struct<kind, text>>).

    Annual reports give four items and their first list of subsidiaries, current
    reports three items, proxies the whole. Cleaned texts under MIN_CHARS go.
    """
    keep = ["ticker", "company", "cik", "form", "accession", "filing_date"]
    items = filings.select(*keep, F.explode("sections").alias("item", "raw"))
    wanted = ((F.col("form") == "10-K") & F.col("item").isin(*ANNUAL_ITEMS)) | ((F.col("form") == "8-K") & F.col("item").isin(*CURRENT_ITEMS)) | (F.col("form") == "DEF 14A")
    items = items.filter(wanted).select(*keep, F.when(F.col("form") == "DEF 14A", F.col("form")).otherwise(F.concat_ws("/", "form", "item")).alias("section_path"), "raw")
    first = F.get(F.filter("exhibits", lambda e: e["kind"].startswith("EX-21")), F.lit(0))
    exhibit = filings.filter(F.col("form") == "10-K").select(*keep, F.lit("10-K/EX-21").alias("section_path"), first["text"].alias("raw")).filter(F.col("raw").isNotNull())
    return items.unionByName(exhibit).withColumn("text", X.clean("raw")).drop("raw").filter(F.length("text") >= MIN_CHARS)
