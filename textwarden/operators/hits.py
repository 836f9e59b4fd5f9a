"""Tokens that dictionaries know, and the words around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.runtime import materialise, small
from textwarden.sources.dictionaries import words_in


def explode_tokens(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``doc_id``, ``pos``, ``token``; of documents that have gone through ``with_known`` the known tokens only."""
    if "known" in docs.columns:
        return docs.select("doc_id", F.explode("known").alias("k")).select("doc_id", "k.pos", "k.token")
    return docs.select("doc_id", F.posexplode(tokens).alias("pos", "token"))


def with_known(docs: DataFrame, words: list[str], tokens: str = "tokens") -> DataFrame:
    """``tokens`` replaced by ``n_tokens`` and ``known``, the tokens among ``words`` with their positions: all that dictionaries can tell of a document, without a shuffle."""
    placed = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
    return docs.withColumns({"n_tokens": F.size(tokens), "known": F.filter(placed, lambda x: x["token"].isin(words))}).drop(tokens)


def known_once(docs: DataFrame, *dictionaries: DataFrame) -> DataFrame:
    """``docs`` after ``with_known``, written once, so that texts are read and tokenised once however often the result is used. As it is if that has been done, or if the dictionaries are too large for a list of their words."""
    if "known" in docs.columns:
        return docs
    lists = [words_in(d, "word") for d in dictionaries]
    if any(words is None for words in lists):
        return docs
    return materialise(with_known(docs, sorted(set().union(*lists))), "known-tokens")


def token_count(docs: DataFrame) -> Column:
    return F.col("n_tokens") if "n_tokens" in docs.columns else F.size("tokens")


def lexicon_lookup(tokens: DataFrame, lexicon: DataFrame, negations: DataFrame, intensifiers: DataFrame) -> DataFrame:
    """Adds ``polarity`` (0), ``intensity`` (1), ``category`` (''), ``multiplier`` (1) and ``is_negation`` to each token."""
    found = tokens.join(small(lexicon), tokens["token"] == lexicon["word"], "left").drop("word")
    found = found.join(small(intensifiers.select(F.col("word").alias("__w"), "multiplier")), F.col("token") == F.col("__w"), "left").drop("__w")
    found = found.join(small(negations.select(F.col("word").alias("__n"))), F.col("token") == F.col("__n"), "left")
    return found.select(
        *tokens.columns,
        F.coalesce("polarity", F.lit(0)).alias("polarity"),
        F.coalesce("intensity", F.lit(1)).alias("intensity"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("multiplier", F.lit(1)).alias("multiplier"),
        F.col("__n").isNotNull().alias("is_negation"),
    )


def keyword_hits(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """``doc_id``, ``word``, ``category``, ``weight``, ``n`` and ``first_pos`` of each keyword that is a whole token."""
    met = tokens.join(small(keywords), tokens["token"] == keywords["word"])
    return met.groupBy("doc_id", "word", "category", "weight").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def _around(first: int, last: int):
    return Window.partitionBy("doc_id").orderBy("pos").rangeBetween(first, last)


def with_context(found: DataFrame) -> DataFrame:
    """Adds ``negations``, the number in the three tokens before, and ``factor``, the product of the two before, from 0.2 to 3.

    Tokens that no dictionary knows are dropped first: the frames are ranges of positions, not rows.
    """
    known = found.filter("polarity != 0 or multiplier != 1 or is_negation")
    before = [F.coalesce(F.max("multiplier").over(_around(-k, -k)), F.lit(1)) for k in (1, 2)]
    product = (before[0] * before[1]).cast("decimal(6,2)")
    factor = F.least(F.greatest(product, F.lit("0.20").cast("decimal(6,2)")), F.lit("3.00").cast("decimal(6,2)"))
    return known.withColumns({"negations": F.coalesce(F.sum(F.col("is_negation").cast("int")).over(_around(-3, -1)), F.lit(0)), "factor": factor})
