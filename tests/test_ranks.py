"""Ranks and quantiles against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.operators.ranks import _sorted, exact_quantiles, with_rank
from textwarden.plans import report

AT = [0.0, 0.25, 0.5, 0.77, 1.0]


def quantiles(values):
    return pytest.approx([float(np.quantile(np.array(values), p)) for p in AT], rel=1e-12, abs=1e-12)


def test_quantiles_of_groups(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 7.0, 7.0, rnd.gauss(0, 5)])) for _ in range(900)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None)] + [("hot", 1.0)] * 2000 + [("hot", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: r.q for r in exact_quantiles(df, "v", AT, ["g"], partitions=7).collect()}
    assert set(found) == {"a", "b", None, "one", "two", "hot"}
    for g, q in found.items():
        assert q == quantiles([v for k, v in rows if k == g and v is not None])


def test_quantiles_of_all(spark):
    """More distinct values than any task has."""
    df = spark.range(20_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    values = [r.v for r in df.collect()]
    assert exact_quantiles(df, "v", AT, partitions=16).first().q == quantiles(values)
    rows, _ = _sorted(df.groupBy("v").agg(F.count("*").alias("n")), [], [F.col("v")], F.col("n"), 16)
    assert rows.groupBy("__part").count().agg(F.max("count")).first()[0] < len(set(values)) / 4
    assert exact_quantiles(df.limit(0), "v", AT).collect() == []


def test_described(spark):
    pages = spark.createDataFrame([("s", 3), ("s", 1), ("t", None), ("t", 10), (None, 4)], "source_site string, text_length int")
    r = report.text_length_stats(pages).first()
    assert (r["count"], r["min"], r.p25, r.p50, r.p75, r["max"]) == (4, 1, 2.5, 3.5, 5.5, 10)
    assert report.text_length_stats(pages.limit(0)).first().p50 is None
    assert [(x.source_site, x.median, x.n) for x in report.text_length_by_source(pages).collect()] == [("t", 10.0, 1), ("s", 2.0, 2)]
    empty = spark.createDataFrame([("u", None)], "source_site string, text_length int")
    assert [(x.source_site, x.median, x.n) for x in report.text_length_by_source(empty).collect()] == [("u", None, 0)]


def test_ranks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id int, n int").repartition(3)
    found = with_rank(df, ["g"], [F.desc("n"), F.col("id")], partitions=9).collect()
    assert len(found) == len(rows)
    for g in ("a", "b", None):
        mine = sorted(((-r.n, r.id) for r in found if r.g == g))
        assert [(-r.n, r.id) for r in sorted((r for r in found if r.g == g), key=lambda r: r.rank)] == mine
        assert sorted(r.rank for r in found if r.g == g) == list(range(1, len(mine) + 1))
