"""The corpus pipeline: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import exact_dedup, lang_id, packing, simhash, suffix_dedup
from textwarden.llm.queries import PACKING_WEIGHTS, tokenizer_file
from textwarden.runtime import materialise

#: A document whose language is less sure than this, or that has no letter, is rejected.
LEAST_SCORE = 0.5
#: Words that a worker of the last stage keeps: fewer than by itself, as workers still hold what earlier stages left them.
WORKER_WORDS = 150_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach. Where nothing is labelled nothing can be rejected but texts without a letter."""
    model = lang_id.fit(docs)
    if not model.classes:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    guessed = docs.select(F.struct("*").alias("row"), lang_id.predict(F.col("text"), model).alias("guess"))
    return guessed.filter((F.col("guess.lang") != lang_id.UNDETERMINED) & (F.col("guess.score") >= LEAST_SCORE)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without blanks, the longest, then the one with the smallest key. Null and blank texts are one group; null keys lose to others; extra columns stay."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest key, of each group of texts linked by 0.8 or more of their five-word shingles. Rows with a null key or text, and texts without words, stay; extra columns stay."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages, all places of each; a document of which nothing is left goes. Null and empty texts stay, as do null keys and extra columns; of repeated rows all lose what they share, so long ones go."""
    return suffix_dedup.cut_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its sequence and place there; null and empty texts are their end id alone, repeated rows each have their own place, extra columns are not kept."""
    cut = materialise(packing.pieces(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048, words=WORKER_WORDS), "pieces")
    return packing.pack(cut, capacity=2048, max_documents=2048, max_attention=2048.0**2, weights=PACKING_WEIGHTS)


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: The model, the similarity and the packing can't be stated in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
