"""Sensitivity, sentiment and harm of documents.

Sums are exact decimals until the last division or ``tanh``, so they don't depend on the order
of rows; weights have two decimals at most. Every operator gives a row for each document of
``docs`` (``doc_id``, ``tokens``, or what ``hits.with_known`` makes of them), with the defaults
where nothing is found. Lists are ordered by
first position, then word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.values import CATEGORY_WEIGHTS, HARM_RULES
from textwarden.operators.hits import explode_tokens, keyword_hits, known_once, lexicon_lookup, token_count, with_context


def _decimal(text: str) -> Column:
    return F.lit(text).cast("decimal(4,2)")


def sensitivity(docs: DataFrame, words: DataFrame, weights: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, ``score``, ``flags``, ``matched``, ``is_sensitive``. ``words``: ``word``, ``category``, ``weight``."""
    weights = weights or CATEGORY_WEIGHTS
    weight_of = F.create_map(*(x for c, w in weights.items() for x in (F.lit(c), _decimal(w))))
    docs = known_once(docs.select(*(c for c in ("doc_id", "tokens", "n_tokens", "known") if c in docs.columns)), words)
    hits = keyword_hits(explode_tokens(docs), words.withColumn("weight", F.col("weight").cast("decimal(4,2)")))
    hits = hits.withColumn("part", F.col("weight") * F.element_at(weight_of, F.col("category")) * F.col("n").cast("decimal(9,0)"))
    categories = hits.groupBy("doc_id", "category").agg(F.sum("part").alias("part"), F.min(F.struct("first_pos", "word")).alias("at"), F.collect_list(F.struct("first_pos", "word")).alias("words"))
    folded = categories.groupBy("doc_id").agg(
        F.sum("part").alias("sum"),
        F.sort_array(F.collect_list(F.when(F.col("part") > 0.05, F.struct("at", "category")))).alias("flags"),
        F.sort_array(F.flatten(F.collect_list("words"))).alias("words"),
    )
    divisor = max(5 * sum(float(w) for w in weights.values()), 1.0)
    score = F.least(F.lit(1.0), F.coalesce(F.col("sum").cast("double"), F.lit(0.0)) / divisor)
    none = F.array().cast("array<string>")
    return docs.select("doc_id").join(folded, "doc_id", "left").select(
        "doc_id", F.round(score, 4).alias("score"), F.coalesce(F.col("flags.category"), none).alias("flags"),
        F.coalesce(F.col("words.word"), none).alias("matched"), (score > 0.05).alias("is_sensitive"),
    )


def sentiment_hits(docs: DataFrame, lexicon: DataFrame, negations: DataFrame, intensifiers: DataFrame) -> DataFrame:
    """A row for each sentiment word: ``doc_id``, ``pos``, ``word``, ``original``, ``adjusted``, ``is_positive``, ``negation_applied``, ``intensifier_applied``.

    An odd number of negations in the three tokens before turns a word around (-0.7), an even one
    weakens it (0.85); negations that the lexicon lists are words themselves.
    """
    exact = lexicon.withColumn("polarity", F.col("polarity").cast("decimal(4,2)"))
    exact = exact if "intensity" in exact.columns else exact.withColumn("intensity", F.lit(1.0))
    exact = exact if "category" in exact.columns else exact.withColumn("category", F.lit("sentiment"))
    strength = intensifiers.withColumn("multiplier", F.col("multiplier").cast("decimal(4,2)"))
    found = with_context(lexicon_lookup(explode_tokens(docs), exact, negations, strength)).filter("polarity != 0")
    turn = F.when(F.col("negations") == 0, _decimal("1.00")).when(F.col("negations") % 2 == 1, _decimal("-0.70")).otherwise(_decimal("0.85"))
    value = F.col("polarity") * turn * F.col("factor")
    return found.select(
        "doc_id", "pos", F.col("token").alias("word"), F.col("polarity").alias("original"), F.round(value, 3).cast("decimal(8,3)").alias("adjusted"),
        (value > 0).alias("is_positive"), (F.col("negations") % 2 == 1).alias("negation_applied"), (F.col("factor") != 1).alias("intensifier_applied"),
    )


def sentiment(docs: DataFrame, lexicon: DataFrame, negations: DataFrame, intensifiers: DataFrame, positive: float = 0.65, negative: float = 0.35, most: int = 20) -> DataFrame:
    """``doc_id``, ``score``, ``label``, ``confidence``, ``n_words``, ``n_positive``, ``n_negative``, ``hits`` (the first ``most``), ``method``.

    The thresholds are for a scale from 0 to 1 but the score runs from -1 to 1: that is the rule
    to reproduce, and both are parameters. Fewer than two tokens, or no hit, give the default.
    """
    docs = known_once(docs.select(*(c for c in ("doc_id", "tokens", "n_tokens", "known") if c in docs.columns)), lexicon, negations, intensifiers)
    hits = sentiment_hits(docs, lexicon, negations, intensifiers)
    folded = hits.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("adjusted").alias("sum"), F.count_if("is_positive").alias("n_positive"),
        F.slice(F.sort_array(F.collect_list(F.struct("pos", "word", "original", "adjusted", "negation_applied", "intensifier_applied"))), 1, most).alias("hits"),
    )
    found = docs.select("doc_id", (token_count(docs) >= 2).alias("enough")).join(folded, "doc_id", "left")
    has = F.col("enough") & F.col("n").isNotNull()
    total = F.col("sum").cast("double")
    score = F.tanh(total / F.sqrt(F.col("n") + 1))
    confidence = F.least(F.lit(1.0), F.abs(total) / 3 * F.least(F.lit(1.0), F.col("n") / 5))
    label = F.when(score > positive, "positive").when(score < negative, "negative").otherwise("neutral")
    return found.select(
        "doc_id", F.when(has, F.round(score, 4)).otherwise(0.0).alias("score"), F.when(has, label).otherwise("neutral").alias("label"),
        F.when(has, F.round(confidence, 4)).otherwise(0.0).alias("confidence"), F.when(has, F.col("n")).otherwise(0).alias("n_words"),
        F.when(has, F.col("n_positive")).otherwise(0).alias("n_positive"), F.when(has, F.col("n") - F.col("n_positive")).otherwise(0).alias("n_negative"),
        F.when(has, F.col("hits")).alias("hits"), F.when(has, "lexicon").otherwise("default").alias("method"),
    )


def sentiment_fallback(docs: DataFrame, raw: str = "raw", margin: float = 0.15) -> DataFrame:
    """Score, label and confidence from a model's score from 0 to 1; the default where it is null."""
    score = (F.col(raw) - 0.5) * 2
    label = F.when(score > margin, "positive").when(score < -margin, "negative").otherwise("neutral")
    return docs.select(
        "doc_id", F.coalesce(F.round(score, 4), F.lit(0.0)).alias("score"), F.when(score.isNull(), "neutral").otherwise(label).alias("label"),
        F.coalesce(F.round(F.abs(F.col(raw) - 0.5) * 2, 4), F.lit(0.0)).alias("confidence"),
    )


def with_harm_regex(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with layer 1: ``l1``, an array of the rules met with count, contribution and three samples, and ``l1_score``. An empty text is taken from its tokens."""
    read = F.col(text)
    if "tokens" in docs.columns:
        read = F.when(F.coalesce(read, F.lit("")) == "", F.concat_ws("", "tokens")).otherwise(read)
    # Each text is searched once for each rule: what is found is counted, and its first three are the samples.
    found = F.array(*(F.struct(F.lit(name).alias("rule"), _decimal(weight).alias("weight"), F.regexp_extract_all(read, F.lit(pattern), F.lit(group)).alias("found")) for name, (pattern, weight, group) in HARM_RULES.items()))

    def counted(r):
        n = F.size(r["found"])
        return F.struct(r["rule"].alias("rule"), n.alias("n"), (r["weight"] * F.least(n, F.lit(5))).cast("decimal(6,2)").alias("part"), F.slice(r["found"], 1, 3).alias("samples"))

    met = F.transform(F.filter(found, lambda r: F.size(r["found"]) > 0), counted)
    total = F.aggregate("l1", F.lit(0).cast("decimal(8,2)"), lambda a, r: (a + r["part"]).cast("decimal(8,2)"))
    return docs.withColumn("l1", met).withColumn("l1_score", F.least(F.lit(1.0), total.cast("double") / 3))


def harm_regex(docs: DataFrame, text: str = "text") -> DataFrame:
    """Layer 1: ``doc_id``, ``l1``, ``l1_score``."""
    return with_harm_regex(docs, text).select("doc_id", "l1", "l1_score")


def harm_keywords(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Layer 2: ``doc_id``, ``l2_score``, ``l2_categories`` and ``l2``, the keywords met, for documents with some."""
    hits = keyword_hits(explode_tokens(docs), keywords.withColumn("weight", F.col("weight").cast("decimal(4,2)")))
    part = F.col("weight") * F.least("n", F.lit(5)).cast("decimal(2,0)") * _decimal("0.15")
    return hits.withColumn("part", part).groupBy("doc_id").agg(
        F.least(F.lit(1.0), F.sum("part").cast("double")).alias("l2_score"),
        F.array_sort(F.collect_set("category")).alias("l2_categories"),
        F.sort_array(F.collect_list(F.struct("first_pos", "word", "category", "n"))).alias("l2"),
    )


def harm_rules(rules: Column, categories: Column) -> Column:
    """Layer 3: ``struct<bonus, flags, details>`` from the names of the rules met and the keyword categories met."""
    met = lambda *names: F.arrays_overlap(rules, F.array(*map(F.lit, names)))
    of = lambda name: F.array_contains(categories, name)
    # Condition, bonus, flag and text, in this order.
    table = [
        (of("gambling") & met("phone_cn", "qq_number", "wechat_id"), "0.30", "gambling", "赌博+联系方式"),
        (of("fraud") & met("bank_card"), "0.30", "fraud", "欺诈+银行卡"),
        (of("fraud") & met("phone_cn", "qq_number"), "0.20", "fraud", "欺诈+联系方式"),
        (of("porn") & met("phone_cn", "qq_number", "wechat_id", "url_link"), "0.25", "porn", "色情+联系方式"),
        (of("spam_marketing") & (F.size(rules) >= 2), "0.15", "spam", "多条推广"),
        (of("violence"), "0.20", "violence", "暴力关键词"),
    ]
    held = lambda value: F.array_compact(F.array(*(F.when(c, value(b, f, t)) for c, b, f, t in table)))
    bonus = F.aggregate(held(lambda b, f, t: _decimal(b)), F.lit(0).cast("decimal(6,2)"), lambda a, x: (a + x).cast("decimal(6,2)"))
    return F.struct(bonus.alias("bonus"), F.array_distinct(held(lambda b, f, t: F.lit(f))).alias("flags"), F.array_join(held(lambda b, f, t: F.lit(t)), "; ").alias("details"))


def harmful(docs: DataFrame, keywords: DataFrame, text: str = "text", threshold: str = "0.3") -> DataFrame:
    """All three layers: ``doc_id``, ``score``, ``is_harmful``, ``flags``, ``details``, ``l1``, ``l2``. Fewer than three tokens give the default. An empty text is taken from its tokens."""
    if "l1" not in docs.columns:
        docs = with_harm_regex(docs, text)
    docs = known_once(docs.drop(text), keywords)
    first = docs.select("doc_id", (token_count(docs) >= 3).alias("enough"), "l1", "l1_score")
    found = first.join(harm_keywords(docs, keywords), "doc_id", "left")
    none = F.array().cast("array<string>")
    found = found.withColumn("third", harm_rules(F.col("l1.rule"), F.coalesce("l2_categories", none)))
    exact = lambda c, w: (F.round(F.coalesce(c, F.lit(0.0)), 8).cast("decimal(12,8)") * _decimal(w)).cast("decimal(14,8)")
    score = F.least(F.lit("1").cast("decimal(14,8)"), exact(F.col("l1_score"), "0.30") + exact(F.col("l2_score"), "0.40") + (F.col("third.bonus") * _decimal("0.30")).cast("decimal(14,8)"))
    enough = F.col("enough")
    return found.select(
        "doc_id", F.when(enough, F.round(score, 4).cast("double")).otherwise(0.0).alias("score"),
        F.when(enough, F.round(score, 6) >= F.lit(threshold).cast("decimal(8,6)")).otherwise(False).alias("is_harmful"),
        F.when(enough, F.col("third.flags")).otherwise(none).alias("flags"), F.when(enough, F.col("third.details")).otherwise("").alias("details"),
        F.when(enough, F.col("l1")).alias("l1"), F.when(enough, F.col("l2")).alias("l2"),
    )
