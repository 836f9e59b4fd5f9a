"""Which pages are new, and which site a page belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.sources.keyed import KeyedTable


def new_urls(candidates: DataFrame, pages: DataFrame | KeyedTable) -> DataFrame:
    """Candidates whose URL isn't stored. Of a keyed table only the files that may hold one of them are read, and none of its rows moves."""
    if isinstance(pages, KeyedTable):
        return pages.without(candidates)
    return candidates.join(pages.select("url"), "url", "left_anti")


def known_urls(candidates: DataFrame, pages: DataFrame | KeyedTable) -> DataFrame:
    """Candidates whose URL is stored, as ``new_urls``."""
    if isinstance(pages, KeyedTable):
        return pages.having(candidates)
    return candidates.join(pages.select("url"), "url", "left_semi")


def assign_site(pages: DataFrame, url_map: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``source_site`` and ``category``: by the exact URL, else by the first profile whose domain is in the URL, else ``unknown``.

    ``url_map``: ``url``, ``site``. ``profiles``: ``key``, ``domain``, ``category``, a few dozen rows.
    """
    known = profiles.select(F.col("key").alias("__key"), "domain", F.col("category").alias("__category"))
    ordered = known.agg(F.sort_array(F.collect_list(F.struct("__key", "domain", "__category"))).alias("__profiles"))
    found = pages.join(url_map.select("url", F.col("site").alias("__site")).dropDuplicates(["url"]), "url", "left").join(F.broadcast(ordered))
    match = F.get(F.filter("__profiles", lambda p: F.contains(F.col("url"), p["domain"])), 0)
    site = F.coalesce("__site", match["__key"], F.lit("unknown"))
    of_site = F.get(F.filter("__profiles", lambda p: p["__key"] == F.col("source_site")), 0)
    return found.withColumn("source_site", site).withColumn("category", F.coalesce(of_site["__category"], F.lit("general"))).drop("__site", "__profiles")
