"""The queries of this package; ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import bpe_automaton, exact_dedup, fill_middle, fingerprint, id_files, lang_id, license_scan, packing, sharding, simhash, suffix_dedup, toxicity, whitening
from textwarden.llm.token_ids import small_batches
from textwarden.runtime import materialise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 by law ``rows``. Null text: 16 bytes, crc32 of the empty text. Every row has a place, repeated rows and null keys too; an empty table gives none."""
    sharded = sharding.shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), 40)
    return sharded.select(
        "doc_id",
        sharding.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document as read back from the files. Null and empty texts are their end id alone; null keys come first; repeated keys each have their own ids."""
    docs = documents(spark, sf_dir)
    folder, manifest, bounds = id_files.write_ids(docs, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return id_files.read_ids(docs.select("doc_id"), folder, manifest, bounds)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that a 200-byte string covers which starts elsewhere too. Null and shorter texts stay whole; repeated rows are copies of each other; null keys stay null."""
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir), width=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by the automaton, and the text they decode to. Null and empty texts have no ids; rows with any key, repeated ones too, come back."""
    small_batches(spark)
    path = tokenizer_file("byte_bpe_50k.json")
    coded = documents(spark, sf_dir).select("doc_id", bpe_automaton.round_trip(F.col("text"), path).alias("coded"))
    return coded.select("doc_id", "coded.*").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and of its edited text, and their likeness. Null and empty texts have the empty fingerprint, 1 like one another; a null key comes first; ties go by the text's hash."""
    return fingerprint.compare_with_edits(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document. Null and wordless texts have fingerprint zero and link like others; null keys are linked but name no component."""
    found = simhash.two_bit_components(documents(spark, sf_dir), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of each document's group of equal texts. Null counts as empty; ties go to the smallest key, null keys last."""
    return exact_dedup.exact_groups(documents(spark, sf_dir)).withColumnRenamed("text_digest", "text_sha256")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License matches of each whole document, by place; none for null and empty texts."""
    small_batches(spark)
    found = documents(spark, sf_dir).select("doc_id", license_scan.matches(F.col("text")).alias("matches"))
    return found.select("doc_id", F.size("matches").alias("n_matches"), "matches")


#: Tokens, documents, attention cost.
PACKING_WEIGHTS = (1.0, 1.0, 1.0)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document. Null and empty texts are their end id alone; repeated rows and null keys each have a place."""
    cut = packing.pieces(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)
    cut = materialise(cut, "pieces")
    # Every document has a token at least, so neither limit asks for more sequences; all three residuals weigh in the choice.
    return packing.pack(cut, capacity=2048, max_documents=2048, max_attention=2048.0**2, weights=PACKING_WEIGHTS)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by a model of those that are not held out; documents with a null key aren't. ``und`` with score 0 for texts without a letter, and for all where nothing is labelled."""
    docs = documents(spark, sf_dir)
    model = lang_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    guessed = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), lang_id.predict(F.col("text"), model).alias("guess"))
    return guessed.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading components of the distinct vectors and each usable vector on them. Rows with a null or non-finite entry, or without a vector, have none; repeated rows each have their own."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4, scale=256)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of each document's fill-in-the-middle output and of the text restored from it. Null counts as empty; empty texts and those with a marker are plain, without lengths."""
    made = fill_middle.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), seed="1")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and toxic spans of each document by a model of the labelled ones that are not held out; documents with a null key aren't. Null and empty texts get the score of a text without tokens; without labels of both kinds all scores are 0."""
    docs, out = documents(spark, sf_dir), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~out)
    scored = docs.select("doc_id", out.alias("held_out"), toxicity.score(F.col("text"), toxicity.fit(docs, labels)).alias("found"))
    return scored.select("doc_id", "held_out", "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.spans")


QUERIES = {f.__name__: f for f in (op1_external_shuffle, op2_id_files, op3_suffix_dedup, op4_bpe_automaton, op5_winnowing, op6_license_scan, op7_best_fit_packing, op8_simhash, op9_exact_dedup, op10_language_id, op11_whitening, op12_fill_in_middle, op13_toxicity)}

ORACLE_SQL = {
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY content) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(content) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY content ORDER BY chars DESC, doc_id)
    """,
    "op12_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
        u AS (
            SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
                   [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS draw FROM d),
        n AS (
            SELECT *, len(units) AS n, least(draw[1] % (len(units) + 1), draw[2] % (len(units) + 1)) AS a, greatest(draw[1] % (len(units) + 1), draw[2] % (len(units) + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw[3] % 100 >= 90 THEN 'plain' WHEN draw[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        c AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM n)
        SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM c
    """,
}
