"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in a task's memory, by a seeded hash
of the record and of its number among records equal in every column, so that no key, source or
group of copies can make a bucket hot, and that the order depends on the rows and the seed alone.
Pass 2 draws a Fisher-Yates permutation of each bucket (Spark's seeded ``shuffle``) in a task of
its own and writes it. The buckets one after another are a random order of the whole input; shard ``i`` of ``n``
is the ``i``-th of ``n`` equal slices of that order, so row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.runtime import materialise, scratch

#: Rows of the bucket table (16 bytes each) up to which it is broadcast; beyond, a shuffle join.
BROADCAST_BUCKETS = 1_000_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 16 for the record's frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def bucket_count(df: DataFrame, text: str, bucket_bytes: int) -> int:
    """As many buckets as hold ``bucket_bytes`` each; the bytes alone decide, not the cluster."""
    total = df.agg(F.sum(text_size(F.col(f"`{text}`")))).first()[0] or 0
    return max(1, math.ceil(total / bucket_bytes))


def numbered(records: DataFrame, seed: int) -> DataFrame:
    """``rec``, two seeded hashes of it, ``h`` and ``other``, and ``nth`` (from 0), its number among equal records.

    Records whose hash is there once, as a rule all, keep their place in the plan. The others are
    counted where they are and written out again as often as they were there.
    """
    hashed = records.select("rec", F.xxhash64(F.lit(seed), F.col("rec")).alias("h"), F.xxhash64(F.col("rec"), F.lit(seed)).alias("other"))
    repeated = materialise(hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated-records")
    single = F.lit(0).cast("long").alias("nth")
    n = repeated.limit(BROADCAST_BUCKETS + 1).count()
    if not n:
        return hashed.select("*", single)
    repeated = F.broadcast(repeated) if n <= BROADCAST_BUCKETS else repeated
    counted = hashed.join(repeated, "h", "left_semi").groupBy("rec", "h", "other").agg(F.count("*").alias("n"))
    again = counted.select("rec", "h", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    return hashed.join(repeated, "h", "left_anti").select("rec", "h", "other", single).unionByName(again)


def shuffle_into_shards(
    df: DataFrame, shards: int, seed: int = 42, bucket_bytes: int = 16 * 2**20, text: str = "text", path: str | None = None
) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard).

    The shuffled buckets are written as Parquet to ``path`` (default: a new folder in the shared
    folder) and the result reads them. Null text counts as 16 bytes; every row is kept, repeated
    rows each get a place of their own; columns of ``df`` called ``shard`` or ``slot`` are
    replaced; an empty table gives an empty result. With more shards than rows some stay empty.
    """
    spark = df.sparkSession
    buckets = bucket_count(df, text, bucket_bytes)
    path = path or scratch(spark, "shards")
    records = numbered(df.select(F.struct("*").alias("rec")), seed)
    scattered = records.withColumn("bucket", F.pmod(F.xxhash64("h", "nth"), F.lit(buckets)).cast("int"))
    # One task for each bucket; sorted by their hashes, the rows don't depend on which map output came first.
    dealt = scattered.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "h", "other", "nth")
    dealt = dealt.groupBy("bucket").agg(F.collect_list("rec").alias("recs"))
    mixed = dealt.select("bucket", F.posexplode(F.shuffle("recs", seed)).alias("pos", "rec"))
    mixed.write.parquet(path)
    written = spark.read.schema(mixed.schema).parquet(path)

    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = starts.select(
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    if buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    place = F.col("before") + F.col("pos")
    placed = written.join(starts, "bucket").select("rec", "total", place.alias("place"), F.expr(f"(before + pos) * {shards} div total").alias("at"))
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    first = F.expr(f"(at * total + {shards - 1}) div {shards}")
    return placed.select(*(F.col("rec")[c].alias(c) for c in kept), F.col("at").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=i`` for each shard, rows in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
