"""Exact dedup by skew-safe combining.

Every map task first combines its own equal texts (partial aggregation), the results are merged
by digest and salt, and the salts' winners are combined by digest. The full normalised text is a
grouping key at each of these stages, so texts whose digests collide stay apart. A group of
copies, however large, sends one row from each task to each merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.skew import spread_join
from textwarden.runtime import materialise

SALTS = 16
_LONGS = 2**63


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def without_blanks(text: Column) -> Column:
    """``text`` (null: empty) without U+0020 and U+0009 to U+000D."""
    out = F.coalesce(text, F.lit(""))
    for blank in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rank(chars: Column, key: Column) -> Column:
    """One fixed-width number that is larger for more characters, then for a smaller key; a null key comes last."""
    back = F.coalesce(_whole(_LONGS) - key.cast("decimal(20,0)"), _whole(0))
    return (chars.cast("decimal(10,0)") * _whole(2 * _LONGS) + back).cast("decimal(38,0)")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, normalise=without_blanks) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_digest``.

    Rows are equal when their normalised texts are (null counts as empty). The row with the most
    code points in the original text stays, then the smallest key; null keys come last. Rows that
    share the winner's key, repeated rows, are all marked ``kept`` only if they have as many code
    points as it: give unique keys where one survivor is wanted, or use ``drop_copies``, which
    keeps a single row. Extra columns are not read; an empty table gives an empty result.
    """
    content = normalise(F.col(f"`{text}`"))
    base = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.char_length(F.col(f"`{text}`")), F.lit(0)).alias("chars"), content.alias("content"))
    base = base.withColumn("digest", digest(F.col("content")))

    local = base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("digest", "salt", "content")
    merged = local.agg(F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("best"), F.count("*").alias("size"))
    texts = merged.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    best = F.col("best") % _whole(2 * _LONGS)
    winner = [
        F.when(best > 0, (_whole(_LONGS) - best).cast("long")).alias("keep_id"),
        F.floor(F.col("best") / _whole(2 * _LONGS)).cast("long").alias("keep_chars"),
        F.col("size").alias("group_size"),
    ]
    # Without the text from here on: a digest stands for one text unless its count says otherwise.
    found = texts.select("digest", *winner).groupBy("digest").agg(F.count("*").alias("texts"), *(F.first(c).alias(c) for c in ("keep_id", "keep_chars", "group_size")))
    found = materialise(found, "exact-groups")
    sizes = found.groupBy("digest").agg(F.max("group_size").alias("size"))
    clear = spread_join(base.select("doc_id", "chars", "digest"), found.filter("texts = 1").drop("texts"), "digest", sizes)
    collided = found.filter("texts > 1").select("digest")
    if not collided.isEmpty():
        apart = base.join(collided, "digest").join(texts.select("digest", "content", *winner), ["digest", "content"])
        clear = clear.unionByName(apart.drop("content"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return clear.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_digest"))


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, normalise=without_blanks) -> DataFrame:
    """``df`` without the rows that lose to an equal text; of rows with the same key and an equal text the longest stays, then the one whose columns have the smallest hash.

    Texts are equal as in ``exact_groups``; texts that only share a digest stay apart. Null counts
    as empty, so one of all null and blank texts stays. An empty table gives an empty one. A row
    moves once, by its digest and key, if no other row has both; only where they don't tell a
    winner from other rows, repeated rows or texts that share a digest, texts are compared again.
    """
    groups = exact_groups(df, key, text, digest, normalise).withColumnsRenamed({"text_digest": "of", "doc_id": "winner"})
    kept = groups.groupBy("of", "winner").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")).filter("kept")
    kept = materialise(kept.select("of", "winner", "rows"), "exact-kept")
    content = normalise(F.col(f"`{text}`"))
    marked = df.select(F.struct("*").alias("row"), F.col(f"`{key}`").cast("long").alias("key"), digest(content).alias("digest"))
    same = (F.col("digest") == F.col("of")) & F.col("key").eqNullSafe(F.col("winner"))
    doubtful = materialise(kept.groupBy("of").agg(F.count("*").alias("winners"), F.max("rows").alias("rows")).filter("winners > 1 or rows > 1").select("of"), "exact-doubtful")
    if doubtful.isEmpty():
        return marked.join(kept, same, "left_semi").select("row.*")
    flagged = kept.join(doubtful.withColumn("doubtful", F.lit(True)), "of", "left").select("of", "winner", F.coalesce("doubtful", F.lit(False)).alias("doubtful"))
    found = marked.join(materialise(flagged, "exact-flagged"), same)
    own = F.col("row")[text]
    order = F.struct((-F.coalesce(F.char_length(own), F.lit(0))).alias("chars"), F.col("key").isNull().alias("last"), "key", F.xxhash64(*(F.col("row")[c] for c, kind in df.dtypes if "map<" not in kind)).alias("h"))
    apart = found.filter("doubtful").groupBy("digest", normalise(own).alias("content")).agg(F.min_by("row", order).alias("row"))
    return found.filter(~F.col("doubtful")).select("row").union(apart.select("row")).select("row.*")
