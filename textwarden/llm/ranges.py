"""Range buckets over a numeric key, with boundaries taken from the key's own distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries travel inside the plan as one array literal of at most so many longs (512 KiB).
MAX_BUCKETS = 65_536


def range_bounds(df: DataFrame, key: str, rows_per_bucket: int) -> list[int]:
    """Ascending key values that start a new bucket; the first bucket holds what is below the first of them, and nulls."""
    rows = df.count()
    buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
    if buckets < 2:
        return []
    at = ", ".join(repr(i / buckets) for i in range(1, buckets))
    found = df.select(F.expr(f"percentile_approx(`{key}`, array({at}), {max(10_000, 4 * buckets)})")).first()[0]
    return sorted(set(found or []))


def bounds_literal(bounds: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are not above ``key`` (null: 0), by binary search."""
    if not bounds:
        return F.lit(0)
    array = bounds_literal(bounds)

    def step(state: Column, _: Column) -> Column:
        middle = ((state["lo"] + state["hi"]) / 2).cast("int")
        right = F.get(array, middle) <= key
        open_ = state["lo"] < state["hi"]
        return F.struct(
            F.when(open_ & right, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(open_ & ~right, middle).otherwise(state["hi"]).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, step)["lo"])
