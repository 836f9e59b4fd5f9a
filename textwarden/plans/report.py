"""Reports over the page table: counts, distributions, trends, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.operators.ranks import exact_quantiles


def db_stats(pages: DataFrame) -> DataFrame:
    """All counts of the dashboard in one pass."""
    label = lambda name: F.count_if(F.col("sentiment_label") == name).alias(f"n_{name}")
    return pages.agg(
        F.count("*").alias("total"), F.count_if(F.col("processed") >= 1).alias("n_segmented"), F.count_if(F.col("processed") >= 2).alias("n_analysed"),
        F.count_if(F.col("harmful_is_harmful") == 1).alias("n_harmful"), label("positive"), label("negative"), label("neutral"),
    )


def value_counts(pages: DataFrame, column: str) -> DataFrame:
    """Rows of each value that isn't null, most first, ties by value."""
    return pages.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def source_site_stats(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_site")


def summary_report(pages: DataFrame) -> DataFrame:
    """``db_stats`` with the mean scores of analysed pages (0 without any) and the sites' counts as an array."""
    analysed = F.col("processed") >= 2
    means = pages.agg(*(F.coalesce(F.round(F.avg(F.when(analysed, F.col(c))), 4), F.lit(0.0)).alias(f"avg_{c}") for c in ("sensitivity_score", "harmful_score")))
    sites = source_site_stats(pages).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "source_site", "n"))).alias("sites"))
    return db_stats(pages).join(means).join(sites.select(F.transform("sites", lambda s: F.struct(s["source_site"].alias("source_site"), s["n"].alias("n"))).alias("sites")))


def site_distribution(pages: DataFrame) -> DataFrame:
    return value_counts(pages, "source_site")


def category_distribution(pages: DataFrame) -> DataFrame:
    return value_counts(pages, "category")


def describe(pages: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """Count, mean, standard deviation (n - 1), least, quartiles, most.

    Quartiles are exact, by linear interpolation, of sorted values that no task holds whole; or,
    with an ``accuracy``, values of the column from sketches of a bounded size.
    """
    numbers = [F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")]
    if accuracy is None:
        q = exact_quantiles(pages.select(column), column, [0.25, 0.5, 0.75])
        folded = pages.agg(*numbers).join(F.broadcast(q), how="left")  # a row each
    else:
        folded = pages.agg(*numbers, F.percentile_approx(column, F.array(*map(F.lit, (0.25, 0.5, 0.75))), accuracy).alias("q"))
    return folded.select("count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def text_length_stats(pages: DataFrame, accuracy: int | None = None) -> DataFrame:
    return describe(pages, "text_length", accuracy)


def sensitivity_score_distribution(pages: DataFrame, accuracy: int | None = None) -> DataFrame:
    return describe(pages, "sensitivity_score", accuracy)


def text_length_by_source(pages: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Mean, median (see ``describe``), standard deviation and count of each site, longest first."""
    known = pages.filter("source_site is not null").select("source_site", "text_length")
    numbers = [F.avg("text_length").alias("mean"), F.stddev_samp("text_length").alias("std"), F.count("text_length").alias("n")]
    if accuracy is None:
        medians = exact_quantiles(known, "text_length", [0.5], ["source_site"]).select("source_site", F.col("q")[0].alias("median"))
        found = known.groupBy("source_site").agg(*numbers).join(medians, "source_site", "left")
    else:
        found = known.groupBy("source_site").agg(*numbers, F.percentile_approx("text_length", F.lit(0.5), accuracy).alias("median"))
    return found.select("source_site", "mean", "median", "std", "n").orderBy(F.desc("mean"), "source_site")


def publish_time_trend(pages: DataFrame, column: str = "publish_time") -> DataFrame:
    return pages.select(F.to_date(column).alias("date")).filter("date is not null").groupBy("date").agg(F.count("*").alias("n")).orderBy("date")


def publish_hour_distribution(pages: DataFrame, column: str = "publish_time") -> DataFrame:
    return pages.select(F.hour(column).alias("hour")).filter("hour is not null").groupBy("hour").agg(F.count("*").alias("n")).orderBy("hour")


def word_frequency(pages: DataFrame, algorithm: str = "jieba", top_n: int = 50, algorithms: dict[str, str] | None = None, max_pages: int | None = None) -> DataFrame:
    """The most frequent tokens of segmented pages, ties by word. An unknown algorithm means the first."""
    columns = algorithms or {"jieba": "seg_jieba", "maxmatch": "seg_maxmatch", "dp": "seg_dp"}
    column = columns.get(algorithm, next(iter(columns.values())))
    chosen = pages.filter("processed >= 1")
    chosen = chosen.limit(max_pages) if max_pages is not None else chosen
    return chosen.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top_n)


def sentiment_distribution(pages: DataFrame) -> DataFrame:
    return value_counts(pages, "sentiment_label").orderBy("sentiment_label")


def sentiment_value_counts(pages: DataFrame) -> DataFrame:
    return value_counts(pages, "sentiment_label")


def harmful_site_stats(pages: DataFrame) -> DataFrame:
    found = pages.groupBy("source_site").agg(F.count("harmful_is_harmful").alias("total"), F.coalesce(F.sum("harmful_is_harmful"), F.lit(0)).cast("long").alias("harmful"))
    return found.withColumn("rate", F.col("harmful") / F.greatest("total", F.lit(1))).orderBy(F.desc("rate"), "source_site")


def missing_values_report(pages: DataFrame) -> DataFrame:
    """``column_name``, ``n_missing``, ``percent`` of each column, in one pass."""
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_missing")) for c in pages.columns))
    found = pages.agg(F.count("*").alias("total"), rows.alias("rows")).select("total", F.explode("rows").alias("r"))
    percent = F.when(F.col("total") > 0, F.col("r.n_missing") * 100 / F.col("total")).otherwise(0.0)
    return found.select("r.column_name", "r.n_missing", percent.alias("percent")).orderBy(F.desc("n_missing"), "column_name")


def site_category_crosstab(pages: DataFrame, categories: list[str]) -> DataFrame:
    return pages.groupBy("source_site").pivot("category", categories).count().na.fill(0, categories).orderBy("source_site")


def length_histogram(pages: DataFrame, column: str = "text_length", bins: int = 50) -> DataFrame:
    """``bin`` (from 1), ``low``, ``high``, ``n`` of equal bins that have rows; the last one is closed."""
    values = pages.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width) + 1, F.lit(bins))).otherwise(1).cast("int")
    binned = values.join(F.broadcast(ends)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return binned.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), "n").orderBy("bin")


def site_share(pages: DataFrame) -> DataFrame:
    counts = site_distribution(pages)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("source_site", "n", (F.col("n") * 100 / F.col("total")).alias("percent"))


def ingest_counts(batch: DataFrame, stored: DataFrame, least: int = 50) -> DataFrame:
    """How many pages of a batch (``url``, ``clean_text``) are stored, too short, or known by URL (in the table or earlier in the batch)."""
    long = F.coalesce(F.length("clean_text"), F.lit(0)) >= least
    known = stored.select("url", F.lit(True).alias("known")).distinct()
    urls = batch.groupBy("url").agg(F.count("*").alias("n"), F.count_if(long).alias("n_long")).join(known, "url", "left")
    return urls.agg(
        F.count_if(F.col("known").isNull() & (F.col("n_long") > 0)).alias("n_stored"), F.coalesce(F.sum(F.col("n") - F.col("n_long")), F.lit(0)).alias("n_short"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n_long")).otherwise(F.greatest(F.col("n_long") - 1, F.lit(0)))), F.lit(0)).alias("n_duplicate"),
    )


def processed_pages(pages: DataFrame, limit: int = 1000, offset: int = 0, below: int | None = None) -> DataFrame:
    """Analysed pages, newest id first. Deep pages are better read by ``below``, the last id seen, than by ``offset``."""
    found = pages.filter("processed >= 2")
    found = found.filter(F.col("id") < below) if below is not None else found
    return found.orderBy(F.desc("id")).offset(offset).limit(limit)


def top_chart_words(pages: DataFrame, algorithm: str = "jieba", n: int = 30) -> DataFrame:
    """The words of the bar chart (30) or the cloud (200)."""
    return word_frequency(pages, algorithm, n)
