"""Document fingerprints by winnowing.

Every run of ``K`` code points has a rolling hash, and of every ``W`` consecutive hashes the
smallest is selected, the rightmost where several are equal. Whatever two texts share over
``K + W - 1`` code points thus selects a common hash, in any language and at any offset. A
selected hash is kept with its position.

The rolling hash is a shift-xor polynomial: the hashes of a run's code points, each shifted by
one bit more than the next, combined by exclusive or. Array functions get all of a text's at
once: those of 1, 2, 4, ... code points in turn, each from two neighbours of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.ranges import bounds_literal, range_bounds, range_bucket

#: Code points of a run, and runs of a window; both powers of two.
K = 8
W = 16
#: Code points over which two texts must agree for a common hash to be certain.
SHARED = K + W - 1
#: A selected hash is one long: 32 bits of hash, then how far the position is from the last one that 31 bits can hold, so that the smallest long is the smallest hash and the rightmost position.
_LAST = 2**31 - 1


def beside(array: Column, by: int, f) -> Column:
    """``f`` of each element and the one ``by`` places on (null beyond the end)."""
    return F.zip_with(array, F.slice(array, F.lit(1 + by), F.greatest(F.lit(0), F.size(array) - by)), f)


def with_minima(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with column ``out``: what is selected in each window of ``text``, as packed longs. Fewer than ``K`` code points count as one run, fewer than ``W`` runs as one window; no code points have none."""
    size = F.char_length(text)
    df = df.withColumn(out, F.transform(F.split(text, ""), lambda c: F.xxhash64(c)))
    width = 1
    while width < K:  # beyond the last run: null
        df = df.withColumn(out, beside(F.col(out), width, lambda x, y: F.shiftleft(x, width).bitwiseXOR(y)))  # noqa: B023
        width *= 2
    grams = F.when(size >= K, F.slice(out, F.lit(1), size - (K - 1))).when(size > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(out, F.transform(grams, lambda g, i: F.shiftrightunsigned(g, 1).bitwiseOR(F.lit(_LAST)).bitwiseXOR(i.cast("long"))))
    width = 1
    while width < W:  # minima of 2, 4, 8, ... neighbours, of fewer beyond the last window
        df = df.withColumn(out, beside(F.col(out), width, lambda a, b: F.least(a, b)))
        width *= 2
    return df.withColumn(out, F.slice(out, F.lit(1), F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), size - (SHARED - 1)))))


def moved(selected: Column, by: Column) -> Column:
    """The same hashes ``by`` code points further on."""
    return F.transform(selected, lambda v: v - by.cast("long"))


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda v: F.shiftrightunsigned(v, 31)))


def as_string(selected: Column) -> Column:
    """``hash@position`` entries, in hexadecimal and decimal."""
    return F.array_join(F.transform(selected, lambda v: F.concat(F.lower(F.hex(F.shiftrightunsigned(v, 31))), F.lit("@"), (_LAST - v.bitwiseAND(F.lit(_LAST))).cast("string"))), " ")


def likeness(a: Column, b: Column, both: Column) -> Column:
    """Jaccard similarity of sets of ``a`` and ``b`` hashes, ``both`` of them common; 1 where both are empty."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(both / (a + b - both))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with its texts' fingerprints as a string; an existing column ``out`` is replaced. Null and empty texts have the empty fingerprint."""
    found = with_minima(df.drop(out), F.coalesce(F.col(f"`{text}`"), F.lit("")), out)
    return found.withColumn(out, as_string(F.array_distinct(out)))


def with_next(df: DataFrame, key: str, rows_per_bucket: int = 128) -> tuple[DataFrame, Window, Column]:
    """``df`` dealt into ranges of ``key``, each with a copy of the row that follows its last.

    Gives the rows, the window in which ``lead`` finds a row's successor by ascending key (after
    the last: the first; ties by the text's hash), and the condition that tells rows from copies.
    """
    bounds = range_bounds(df.select(F.col(f"`{key}`").cast("long").alias("key")), "key", rows_per_bucket)
    where = range_bucket(F.col(f"`{key}`").cast("long"), bounds)
    first = df.agg(F.min(F.col(f"`{key}`").cast("long")), F.count_if(F.col(f"`{key}`").isNull())).first()
    head = F.col(f"`{key}`").isNull() if first[1] else F.col(f"`{key}`") == first[0]
    starts = F.array_contains(bounds_literal(bounds), F.col(f"`{key}`").cast("long")) if bounds else F.lit(False)
    # A row that starts a range is also the end of the one before; the very first also ends the last.
    ends = F.when(head, F.lit(len(bounds))).when(starts, where - 1)
    spots = F.filter(F.array(F.struct(where.alias("bucket"), F.lit(False).alias("copy")), F.struct(ends.alias("bucket"), F.lit(True).alias("copy"))), lambda s: s["bucket"].isNotNull())
    dealt = df.withColumn("__spot", F.explode(spots)).withColumn("__bucket", F.col("__spot.bucket")).withColumn("__copy", F.col("__spot.copy")).drop("__spot")
    dealt = dealt.withColumn("__text", F.xxhash64("text"))
    window = Window.partitionBy("__bucket").orderBy("__copy", F.col(f"`{key}`").asc_nulls_first(), "__text")
    return dealt, window, ~F.col("__copy")


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` for each row.

    The edited text of a row is its text with the last floor(n/2) code points replaced by the
    first as many (or all) of the next row's. One exchange deals the rows by ranges of the key;
    all that follows happens in the same stage. A single row is its own successor. Null text
    counts as empty; a null key comes first; extra columns are not read.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dealt, window, own = with_next(rows, "doc_id")
    n, following = F.char_length("text"), F.coalesce(F.col("next_text"), F.lit(""))
    half = F.floor(n / 2).cast("int")
    dealt = dealt.withColumn("next_text", F.lead("text").over(window))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(following, F.lit(1), half))
    stays, comes = n - half, F.least(half, F.char_length(following))
    left, right = F.least(stays, F.lit(SHARED - 1)), F.least(comes, F.lit(SHARED - 1))
    crossed = (left + right >= SHARED) | (stays + comes < SHARED)
    dealt = dealt.select("doc_id", "text", "__bucket", "__copy", "__text", n.alias("n"), stays.alias("stays"), comes.alias("comes"), edited.alias("edited"), left.alias("left"), right.alias("right"), crossed.alias("crossed"))
    # What is needed of the edited text is taken from it before there are arrays to carry it beside.
    seam = F.when(F.col("crossed"), F.substring(F.col("edited"), F.col("stays") - F.col("left") + 1, F.col("left") + F.col("right"))).otherwise("")
    dealt = dealt.withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "seam_text": seam}).drop("edited", "right", "crossed")
    dealt = with_minima(dealt, F.col("seam_text"), "seam").withColumn("seam", F.array_distinct("seam")).drop("seam_text")
    dealt = with_minima(dealt, F.col("text"), "own").drop("text")
    dealt = dealt.withColumn("after", F.coalesce(F.lead("own").over(window), F.array().cast("array<bigint>"))).filter(own)
    # The edited text's windows: those within what stays, those over the seam, those within what comes.
    within = lambda minima, chars: F.array_distinct(F.slice(minima, F.lit(1), F.greatest(F.lit(0), F.col(chars) - (SHARED - 1))))
    changed = F.concat(within("own", "stays"), moved(F.col("seam"), F.col("stays") - F.col("left")), moved(within("after", "comes"), F.col("stays")))
    dealt = dealt.select("doc_id", "n", "edited_sha256", F.array_distinct(changed).alias("changed"), F.array_distinct("own").alias("mine"), hashes(F.col("after")).alias("their_set"))
    dealt = dealt.select("*", hashes(F.col("mine")).alias("own_set"), hashes(F.col("changed")).alias("changed_set"))
    dealt = dealt.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_string(F.col("mine")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        *(F.size(f"{name}_set").alias(name) for name in ("own", "changed", "their")),
        F.size(F.array_intersect("own_set", "changed_set")).alias("own_changed"),
        F.size(F.array_intersect("own_set", "their_set")).alias("own_their"),
    )
    near_edited, near_next = (likeness(F.col("own"), F.col(other), F.col(f"own_{other}")) for other in ("changed", "their"))
    return dealt.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near_edited.alias("near_edited"), near_next.alias("near_next"))
