"""Stored pages, discovered URLs, and link discovery from fetched documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = ["id", "url", "title", "clean_text", "source_site", "category", "publish_time", "text_length", "sensitivity_score", "sentiment_score", "sentiment_label", "harmful_score", "harmful_is_harmful", "processed"]
DISCOVERED = "generated_at string, per_site_limit int, sites map<string, struct<count: int, urls: array<string>>>"


def load_pages(pages: DataFrame | str, spark: SparkSession | None = None, limit: int | None = None) -> DataFrame:
    """Pages with text, with the columns that reports use; ``limit`` is a guard and off by default."""
    df = spark.read.parquet(pages) if isinstance(pages, str) else pages
    found = df.filter("clean_text != ''").select(*(c for c in PAGE_COLUMNS if c in df.columns))
    return found.limit(limit) if limit is not None else found


def read_discovered_urls(spark: SparkSession, path: str, site: str | None = None, max_pages: int = 20_000) -> DataFrame:
    """``site_key``, ``pos``, ``url``: the first ``max_pages`` of each site, or of ``site`` alone if the file has it.

    ``path``: one JSON document of all sites, or the JSON lines of ``write_discovered``, which
    are read by many tasks.
    """
    lines = spark.read.schema("site_key string, pos bigint, urls array<string>").json(path)
    if lines.filter("urls is not null").isEmpty():
        whole = spark.read.schema(DISCOVERED).option("multiLine", True).json(path).select(F.explode("sites").alias("site_key", "found"))
        lines = whole.select("site_key", F.lit(0).cast("long").alias("pos"), F.col("found.urls").alias("urls"))
    if site is not None and not lines.filter(F.col("site_key") == site).isEmpty():
        lines = lines.filter(F.col("site_key") == site)
    urls = lines.select("site_key", F.col("pos").alias("first"), F.posexplode("urls").alias("at", "url"))
    return urls.select("site_key", (F.col("first") + F.col("at")).alias("pos"), "url").filter(F.col("pos") < max_pages)
