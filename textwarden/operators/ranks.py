"""Ranks and exact quantiles of groups that no task holds whole.

Rows are sorted over all tasks by group and order (Spark samples the ranges), each task counts what
it has of each group, and the counts before a task, a row for each group and task, place its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.runtime import materialise, small

_ROW = "__row"


def _sorted(df: DataFrame, groups: list[str], order: list[Column], weight: Column, partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``__part`` and ``__weight``, in order within it, written once; and ``__before``, the weight of each group's rows in earlier parts."""
    by = [*map(F.col, groups), *order]
    dealt = df.withColumn("__weight", weight)
    dealt = dealt.repartitionByRange(partitions, *by) if partitions else dealt.repartitionByRange(*by)
    rows = materialise(dealt.sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), _ROW: F.monotonically_increasing_id()}), "sorted")
    parts = rows.groupBy(*groups, "__part").agg(F.sum("__weight").alias("__n"), F.min(_ROW).alias("__least"))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))


def with_rank(df: DataFrame, groups: list[str], order: list[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with the rank (from 1) of each row in its group by ``order``; rows that are equal by it get ranks in any order."""
    rows, parts = _sorted(df, groups, order, F.lit(1), partitions)
    starts = small(parts.drop("__n"))
    placed = rows.join(starts, [rows[k].eqNullSafe(starts[k]) for k in [*groups, "__part"]]).select(rows["*"], starts["__before"], starts["__least"])
    return placed.withColumn(out, (F.col("__before") + F.col(_ROW) - F.col("__least") + 1).cast("long")).select(*df.columns, out)


def exact_quantiles(df: DataFrame, column: str, at: list[float], groups: list[str] = (), partitions: int | None = None) -> DataFrame:
    """The ``groups`` and ``q``, the values at each part ``at`` of 1 of each group's sorted non-null values, by linear interpolation.

    Equal values are counted first, so a frequent one is one row; of the sorted distinct values each
    task adds up its own, and only the tasks' parts that hold a wanted rank are looked into. A
    group without values has no row.
    """
    groups = list(groups)
    named = {g: f"__g{i}" for i, g in enumerate(groups)}
    values = df.filter(F.col(column).isNotNull()).select(*(F.col(g).alias(n) for g, n in named.items()), F.col(column).cast("double").alias("__v"))
    keys = list(named.values())
    counted = values.groupBy(*keys, "__v").agg(F.count("*").alias("__n0"))
    rows, parts = _sorted(counted, keys, [F.col("__v")], F.col("__n0"), partitions)
    total = parts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    # Each quantile lies between two ranks (from 0).
    place = F.transform(F.array(*map(F.lit, map(float, at))), lambda p: p * (F.col("__total") - 1))
    wanted = total.select(*keys, F.posexplode(place).alias("__i", "__at")).select(*keys, "__i", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__rank"))
    same = lambda a, b, names: [a[k].eqNullSafe(b[k]) for k in names]
    p, w = parts.alias("p"), wanted.alias("w")
    inside = (F.col("w.__rank") >= F.col("p.__before")) & (F.col("w.__rank") < F.col("p.__before") + F.col("p.__n"))
    hit = p.join(w, [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys] + [inside]).select(*(f"p.{k}" for k in keys), "p.__part", "p.__before", "w.__i", "w.__at", "w.__rank")
    hit = materialise(hit, "wanted-ranks")  # a row or two for each group and quantile
    needed = hit.select(*keys, "__part", "__before").distinct()
    looked = rows.join(small(needed), same(rows, needed, [*keys, "__part"])).select(rows["*"], needed["__before"])
    upto = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    from_ = F.col("__before") + F.coalesce(F.sum("__weight").over(upto), F.lit(0))
    spans = looked.withColumn("__from", from_).alias("s")
    h = small(hit).alias("h")
    of = [F.col(f"s.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "__part"]]
    found = spans.join(h, [*of, F.col("h.__rank") >= F.col("s.__from"), F.col("h.__rank") < F.col("s.__from") + F.col("s.__weight")])
    pairs = found.groupBy(*(F.col(f"h.{k}").alias(k) for k in keys), "h.__i", "h.__at").agg(F.min("s.__v").alias("lo"), F.max("s.__v").alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("__at") - F.floor("__at"))
    q = F.transform(F.array_sort(F.collect_list(F.struct("__i", value.alias("v")))), lambda x: x["v"])
    return pairs.groupBy(*keys).agg(q.alias("q")).filter(F.size("q") > 0).select(*(F.col(n).alias(g) for g, n in named.items()), "q")
