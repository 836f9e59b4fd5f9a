"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.runtime import materialise

#: Rows of one key that one task may take, and rows of a small table (16 bytes each) up to which it is broadcast; beyond, a shuffle join.
PER_TASK, BROADCAST_ROWS = 100_000, 1_000_000


def near(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its counted ``rows`` allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread_join(many: DataFrame, one: DataFrame, key: str, sizes: DataFrame | None = None, per_task: int | None = None) -> DataFrame:
    """``many`` and ``one`` joined on ``key``.

    Keys with more than ``per_task`` rows in ``many`` are dealt over as many tasks as that takes,
    each of which gets the key's rows of ``one``. ``sizes`` (``key``, ``size``) saves the count.
    The list of such keys is broadcast: at most ``BROADCAST_ROWS`` keys, as a key with less than
    that part of all rows is no burden for a task.
    """
    most = per_task or PER_TASK
    if sizes is None:
        sizes = many.groupBy(key).agg(F.count("*").alias("size"))
    hot = materialise(sizes.filter(F.col("size") > most).select(key, "size"), "hot-keys")
    number, total = hot.agg(F.count("*"), F.sum("size")).first()
    if not number:
        return many.join(one, key)
    if number > BROADCAST_ROWS:
        most = max(most, -(-total // BROADCAST_ROWS))
    hot = F.broadcast(hot.filter(F.col("size") > most).select(key, F.ceil(F.col("size") / most).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("__parts")
    copied = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")
