"""The whole analysis of pending pages, and where its results and new pages are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.functions.text import pending
from textwarden.operators.detect import harmful, sensitivity, sentiment, with_harm_regex
from textwarden.operators.hits import known_once
from textwarden.operators.segment import segment_pages
from textwarden.operators.sites import new_urls
from textwarden.runtime import materialise, spread
from textwarden.sources.keyed import KeyedTable

RESULTS = ["sensitivity_score", "sensitivity_flags", "sentiment_score", "sentiment_label", "harmful_score", "harmful_flags", "harmful_is_harmful", "sensitivity_details", "sentiment_details", "harmful_details"]
SEGMENTED = ["seg_jieba", "seg_maxmatch", "seg_dp"]


def analyze(pages: DataFrame, tokens: str, dictionaries: dict[str, DataFrame], source: str = "jieba") -> DataFrame:
    """Pending pages (``id``, ``clean_text``, the array column ``tokens``) with all detectors' results, ``processed`` 2 and the source of the tokens.

    ``dictionaries``: ``sensitive``, ``lexicon``, ``negations``, ``intensifiers``, ``keywords``.
    One narrow pass over the texts leaves of each document its known tokens and the rules it meets,
    a small table that is written once; the detectors read that, and the wide rows are joined at the
    end. Where the dictionaries are too large for a list of their words, all tokens are kept.
    """
    rows = pending(pages)
    docs = spread(rows).select(F.col("id").alias("doc_id"), F.col("clean_text").alias("text"), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("tokens"))
    return _with_results(rows, _detected(docs, dictionaries), source)


def segment_and_analyze(pages: DataFrame, dictionary: DataFrame, dictionaries: dict[str, DataFrame], stopwords: list[str] = (), source: str = "jieba", **options) -> DataFrame:
    """Pending pages (``id``, ``clean_text``) with their words by three segmenters, ``seg_jieba``, ``seg_maxmatch`` and ``seg_dp``, and the results of all detectors on those of ``source``.

    The words, what dictionaries know of them and the rules a text meets come from one pass over
    the texts, which is written once. Options are those of ``segment_pages``.
    """
    rows = pending(pages)
    cut = segment_pages(rows.select("id", "clean_text"), dictionary, stopwords, **options)
    docs = cut.select(F.col("id").alias("doc_id"), F.col("clean_text").alias("text"), F.col(f"seg_{source}").alias("tokens"), *SEGMENTED)
    return _with_results(rows.drop(*SEGMENTED), _detected(docs, dictionaries, SEGMENTED), source)


def _detected(docs: DataFrame, dictionaries: dict[str, DataFrame], kept: list[str] = ()) -> DataFrame:
    """``doc_id``, the results of all detectors and the columns ``kept`` of ``docs`` (``doc_id``, ``text``, ``tokens``)."""
    docs = known_once(with_harm_regex(docs).drop("text"), *(dictionaries[d] for d in ("sensitive", "lexicon", "negations", "intensifiers", "keywords")))
    docs = docs if "known" in docs.columns else materialise(docs, "all-tokens")
    one = sensitivity(docs, dictionaries["sensitive"]).select("doc_id", F.col("score").alias("sensitivity_score"), F.col("flags").alias("sensitivity_flags"), F.struct("matched", "is_sensitive").alias("sensitivity_details"))
    two = sentiment(docs, dictionaries["lexicon"], dictionaries["negations"], dictionaries["intensifiers"])
    two = two.select("doc_id", F.col("score").alias("sentiment_score"), F.col("label").alias("sentiment_label"), F.struct("confidence", "n_words", "n_positive", "n_negative", "hits", "method").alias("sentiment_details"))
    three = harmful(docs, dictionaries["keywords"]).select(
        "doc_id", F.col("score").alias("harmful_score"), F.col("flags").alias("harmful_flags"), F.col("is_harmful").cast("int").alias("harmful_is_harmful"), F.struct("details", "l1", "l2").alias("harmful_details"),
    )
    results = one.join(two, "doc_id").join(three, "doc_id")
    return results.join(docs.select("doc_id", *kept), "doc_id") if kept else results


def _with_results(rows: DataFrame, results: DataFrame, source: str) -> DataFrame:
    joined = rows.drop(*RESULTS, "processed", "analysis_seg_source").join(results.withColumnRenamed("doc_id", "id"), "id")
    return joined.withColumns({"processed": F.lit(2), "analysis_seg_source": F.lit(source)})


def append_new_pages(batch: DataFrame, stored: DataFrame | KeyedTable) -> DataFrame:
    """The pages of ``batch`` to append: the first of each URL (by ``crawl_time``, then the text) that ``stored`` doesn't have."""
    order = Window.partitionBy("url").orderBy(F.col("crawl_time").asc_nulls_last(), "clean_text")
    first = batch.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return new_urls(first, stored)


def page_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The stored pages at ``path``, one for each URL."""
    return KeyedTable(spark, path, "url", buckets)


def write_pages(batch: DataFrame, path: str, buckets: int = 64) -> None:
    """Add to the pages at ``path`` those with a new URL; of several in the batch the first by ``crawl_time``, then by text."""
    page_store(batch.sparkSession, path, buckets).insert(batch, [F.col("crawl_time").asc_nulls_last(), F.col("clean_text")])


def analysis_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The analysed pages at ``path``, the latest results of each ``id``."""
    return KeyedTable(spark, path, "id", buckets)


def with_json(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    return df.withColumns(nested) if nested else df


def write_analysis(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Put analysed pages, nested columns as JSON, in place of those with their ``id``; all other pages stay."""
    analysis_store(df.sparkSession, path, buckets).merge(with_json(df))


def discovered(urls: DataFrame) -> DataFrame:
    """``site_key``, ``count`` and the sorted ``urls`` of each site, one row a site: for tables whose sites have few enough URLs for a row."""
    return urls.groupBy("site_key").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("url")).alias("urls"))


def discovered_blocks(urls: DataFrame, block: int = 10_000) -> DataFrame:
    """``site_key``, ``pos``, ``urls``: the sorted URLs of each site in rows of at most ``block``, ``pos`` that of a row's first.

    The URLs are sorted over all tasks, which then count: no site is brought to one of them.
    """
    rows = materialise(urls.select("site_key", "url").repartitionByRange("site_key", "url").sortWithinPartitions("site_key", "url").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "sorted-urls")
    parts = rows.groupBy("site_key", "part").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("site_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("site_key", "part", "least", before.alias("before"))  # a row for each site in each task
    placed = rows.join(starts, ["site_key", "part"]).withColumn("pos", F.col("before") + F.col("row") - F.col("least"))
    blocks = placed.groupBy("site_key", F.floor(F.col("pos") / block).alias("block")).agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list("url")).alias("urls"))
    return blocks.select("site_key", "pos", "urls")


def write_discovered(urls: DataFrame, path: str, block: int = 10_000) -> None:
    """JSON lines of ``discovered_blocks``; ``read_discovered_urls`` reads them."""
    discovered_blocks(urls, block).write.mode("overwrite").json(path)


def token_table(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``algorithm``, ``token`` of the arrays in ``columns`` (algorithm to column), in one pass over the pages."""

    def named(algorithm: str, column: str):
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda t: F.struct(F.lit(algorithm).alias("algorithm"), t.alias("token")))

    lists = [named(a, c) for a, c in columns.items()]
    return pages.select(F.explode(F.flatten(F.array(*lists))).alias("t")).select("t.algorithm", "t.token")
