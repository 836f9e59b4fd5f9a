"""Vocabularies of several segmenters side by side. ``tokens``: ``algorithm``, ``token``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.operators.ranks import with_rank
from textwarden.runtime import materialise


def vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.select("algorithm", F.col("token").alias("word")).distinct()


def _ratio(top, bottom):
    return F.when(bottom > 0, F.round(top / bottom, 4)).otherwise(0.0)


def vocab_similarity(words: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ``jaccard``, ``dice``, ``n_shared``, ``n_only_a``, ``n_only_b``. ``words``: a vocabulary."""
    sides = words.groupBy("word").agg(F.max((F.col("algorithm") == a).cast("int")).alias("in_a"), F.max((F.col("algorithm") == b).cast("int")).alias("in_b"))
    n = sides.agg(F.count_if(F.expr("in_a = 1 and in_b = 1")).alias("n_shared"), F.count_if(F.expr("in_a = 1 and in_b = 0")).alias("n_only_a"), F.count_if(F.expr("in_a = 0 and in_b = 1")).alias("n_only_b"))
    total = F.col("n_shared") + F.col("n_only_a") + F.col("n_only_b")
    return n.select(_ratio(F.col("n_shared"), total).alias("jaccard"), _ratio(2 * F.col("n_shared"), total + F.col("n_shared")).alias("dice"), "n_shared", "n_only_a", "n_only_b")


def shared_vocab(words: DataFrame, a: str, b: str) -> DataFrame:
    return words.filter(F.col("algorithm") == a).select("word").intersect(words.filter(F.col("algorithm") == b).select("word"))


def vocab_only_in(words: DataFrame, a: str, b: str) -> DataFrame:
    return words.filter(F.col("algorithm") == a).select("word").exceptAll(words.filter(F.col("algorithm") == b).select("word"))


def all_pairs_similarity(words: DataFrame) -> DataFrame:
    """``a``, ``b``, ``jaccard``, ``dice``, ``n_shared`` for each pair of algorithms.

    A word's algorithms are at most as many as there are algorithms, so its pairs are few. The
    vocabulary is written once, as it is read twice.
    """
    words = materialise(words, "vocabulary")
    sets = words.groupBy("word").agg(F.array_sort(F.collect_set("algorithm")).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    shared = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n_shared"))
    sizes = words.groupBy("algorithm").agg(F.count("*").alias("n"))
    x, y = sizes.select(F.col("algorithm").alias("a"), F.col("n").alias("n_a")), sizes.select(F.col("algorithm").alias("b"), F.col("n").alias("n_b"))
    every = x.join(F.broadcast(y), F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").fillna(0, ["n_shared"])
    either = F.col("n_a") + F.col("n_b") - F.col("n_shared")
    return every.select("a", "b", _ratio(F.col("n_shared"), either).alias("jaccard"), _ratio(2 * F.col("n_shared"), F.col("n_a") + F.col("n_b")).alias("dice"), "n_shared")


def segmentation_summary(tokens: DataFrame, n_texts: DataFrame) -> DataFrame:
    """``algorithm``, ``n_tokens``, ``n_distinct``, ``per_text`` (one decimal), ``mean_length`` (two). ``n_texts``: one row ``n``."""
    counts = tokens.groupBy("algorithm", "token").agg(F.count("*").alias("n"))
    folded = counts.groupBy("algorithm").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"), F.sum(F.length("token") * F.col("n")).alias("chars"))
    return folded.join(F.broadcast(n_texts)).select("algorithm", "n_tokens", "n_distinct", F.round(F.col("n_tokens") / F.col("n"), 1).alias("per_text"), F.round(F.col("chars") / F.col("n_tokens"), 2).alias("mean_length"))


def token_length_distribution(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("algorithm", F.length("token").alias("length")).agg(F.count("*").alias("n"))


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("algorithm", F.col("token").alias("word")).agg(F.count("*").alias("n"))


def word_ranks(tokens: DataFrame) -> DataFrame:
    """``algorithm``, ``word``, ``n``, ``rank``: by count, ties by word; sorted over all tasks, so that none holds an algorithm's vocabulary."""
    return with_rank(word_counts(tokens), ["algorithm"], [F.desc("n"), F.col("word")])


def word_freq_comparison(tokens: DataFrame, top_n: int = 30) -> DataFrame:
    """The first ``top_n`` ranks of each algorithm: every task sends on as many at most."""
    rank = F.row_number().over(Window.partitionBy("algorithm").orderBy(F.desc("n"), "word"))
    return word_counts(tokens).withColumn("rank", rank).filter(F.col("rank") <= top_n)
