"""Dictionaries from text files, as tables. A repeated word counts as its last line."""

from __future__ import annotations

from collections.abc import Mapping
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.values import CATEGORY_WEIGHTS, HARM_CATEGORIES


#: A file or folder that Spark reads, or lines.
Source = str | list[str]


def _lines(spark: SparkSession, source: Source) -> DataFrame:
    """Lines that aren't blank or comments, trimmed, with a number that grows within the file."""
    if isinstance(source, str):
        found = spark.read.text(source).select("value", F.monotonically_increasing_id().alias("no"))
    else:
        found = spark.createDataFrame(list(enumerate(source)), "no long, value string")
    lines = found.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line"), "no")
    return lines.filter("line != '' and not startswith(line, '#')")


def shipped_lines(name: str) -> list[str]:
    """A dictionary that comes with the library, in the format of its reader."""
    return (files("textwarden") / "data" / name).read_text(encoding="utf-8").splitlines()


def shipped(spark: SparkSession, categories: list[str] | None = None) -> dict[str, DataFrame]:
    """The English dictionaries that come with the library, as ``analyze`` takes them."""
    exact = lambda df, c: df.withColumn(c, F.col(c).cast("decimal(4,2)"))
    return {
        "sensitive": exact(read_sensitive_words(spark, shipped_lines("sensitive.txt"), categories or list(CATEGORY_WEIGHTS)), "weight"),
        "keywords": exact(read_sensitive_words(spark, shipped_lines("harmful.txt"), HARM_CATEGORIES), "weight"),
        "lexicon": exact(read_lexicon(spark, shipped_lines("lexicon.tsv")), "polarity"),
        "negations": read_wordlist(spark, shipped_lines("negations.txt")),
        "intensifiers": exact(read_intensifiers(spark, shipped_lines("intensifiers.txt")), "multiplier"),
    }


def shipped_stopwords() -> list[str]:
    return [w for w in shipped_lines("stopwords.txt") if w and not w.startswith("#")]


def _last(df: DataFrame, word: str, *values: str) -> DataFrame:
    found = df.groupBy(word).agg(F.max_by(F.struct(*values), "no").alias("v"))
    return found.select(word, *(F.col("v")[c].alias(c) for c in values))


def read_lexicon(spark: SparkSession, path: Source) -> DataFrame:
    """``word``, ``polarity``, ``intensity``, ``category`` from tab-separated lines; those with fewer than three fields or a bad number are skipped."""
    parts = F.split("line", "\t")
    rows = _lines(spark, path).filter(F.size(parts) >= 3).select(
        "no", parts[0].alias("word"), parts[1].try_cast("double").alias("polarity"), parts[2].try_cast("double").alias("intensity"),
        F.when(F.size(parts) > 3, F.get(parts, 3)).otherwise("sentiment").alias("category"),
    )
    return _last(rows.filter("polarity is not null and intensity is not null"), "word", "polarity", "intensity", "category")


def read_wordlist(spark: SparkSession, path: Source) -> DataFrame:
    return _lines(spark, path).select(F.col("line").alias("word")).distinct()


def read_intensifiers(spark: SparkSession, path: Source) -> DataFrame:
    """``word``, ``multiplier`` and whether it weakens."""
    parts = F.split("line", r"\s+")
    rows = _lines(spark, path).filter(F.size(parts) >= 2).select("no", parts[0].alias("word"), parts[1].try_cast("double").alias("multiplier"))
    found = _last(rows.filter("multiplier is not null"), "word", "multiplier")
    return found.withColumn("is_diminisher", (F.col("multiplier") > 0) & (F.col("multiplier") < 1))


def read_sensitive_words(spark: SparkSession, path: Source, categories: list[str]) -> DataFrame:
    """``word``, ``category``, ``weight`` from ``category:weight keyword`` lines; malformed lines and unknown categories are skipped."""
    got = lambda i: F.regexp_extract("line", r"^([^:\s]+):(\S+)\s+(.+)$", i)
    rows = _lines(spark, path).select("no", got(3).alias("word"), got(1).alias("category"), got(2).try_cast("double").alias("weight"))
    return _last(rows.filter(F.col("category").isin(categories) & F.col("weight").isNotNull()), "word", "category", "weight")


def keyword_table(spark: SparkSession, spec: Mapping[str, tuple[str, list[str]]]) -> DataFrame:
    """``word``, ``category``, ``weight`` (decimal) from category to weight and words; a repeated word counts as its last."""
    rows = [(c, w, words) for c, (w, words) in spec.items()]
    df = spark.createDataFrame(rows, "category string, weight string, words array<string>").coalesce(1).withColumn("no", F.monotonically_increasing_id())
    each = df.select("category", F.col("weight").cast("decimal(3,2)").alias("weight"), "no", F.posexplode("words").alias("pos", "word"))
    return _last(each.withColumn("no", F.struct("no", "pos")), "word", "category", "weight")


def words_in(df: DataFrame, column: Column | str, most: int = 20_000) -> list[str] | None:
    """A dictionary's words on the driver, or None if there are more than ``most``."""
    rows = df.select(column).distinct().limit(most + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= most else None
