"""Fill-in-the-middle transformation by counted-quantifier patterns.

A text is cut into units, runs of ASCII letters or single other characters. ``regexp_count`` gives
their number; a pattern of each row's own, with possessive ``unit{a}`` and ``unit{b-a}`` groups,
captures prefix, middle and suffix in one match, which ``regexp_replace`` writes in the new order.
Possessive counted groups are loops in Java's patterns, where others recurse once for each unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One unit, and units in a block as they are counted: a count keeps what it finds, so there is a match for each block, then for each unit of what is left.
UNIT, BLOCK = r"(?:[A-Za-z]++|[^A-Za-z])", 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def count_units(text: Column) -> Column:
    blocks = rf"\G{UNIT}{{{BLOCK}}}+"
    rest = F.regexp_replace(text, blocks, "")  # the last units, fewer than a block
    return F.regexp_count(text, F.lit(blocks)).cast("long") * BLOCK + F.regexp_count(rest, F.lit(UNIT))


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``row`` (the input's columns, whatever their names), ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each row.

    The key and ``seed`` alone decide: the places of both cuts, whether the text stays ``plain``
    (``plain_from`` in 100 and more) and else whether the suffix comes first (``spm`` below
    ``spm_below`` in 100). Null counts as empty; empty texts and texts that contain a marker stay
    plain and have no lengths; repeated rows get the same output; a null key counts as empty text.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.array(*draws(F.col(f"`{key}`"), seed)).alias("h"))
    counted = rows.withColumn("n", count_units(F.col("text")))
    h1, h2, h3, h4 = (F.col("h")[i] for i in range(4))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (h3 % 100 >= plain_from), PLAIN).when(h4 % 100 < spm_below, SPM).otherwise(PSM)
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = counted.select("row", "text", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), F.col("a"), F.lit(rf"}}+)({UNIT}{{"), F.col("b") - F.col("a"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == SPM, f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    made = cut.select("row", "n", "form", F.when(F.col("form") == PLAIN, F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"))
    # The text has no marker, so the first of each in the output is ours.
    p, s, m = (F.locate(x, F.col("output")) for x in (PREFIX, SUFFIX, MIDDLE))
    prefix_chars = F.when(F.col("form") == PSM, s - p - 3).when(F.col("form") == SPM, m - p - 3)
    middle_chars = F.when(F.col("form") != PLAIN, F.length("output") - m - 2)
    return made.select("row", "n", "form", prefix_chars.cast("long").alias("prefix_chars"), middle_chars.cast("long").alias("middle_chars"), "output")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` of ``form`` was made from."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
