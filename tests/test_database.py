"""Pages from SQLite files against the same rows in memory."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from textwarden.sources import database, pages

SCHEMA = 'id long, clean_text string, score double, processed int, crawl_time timestamp, `odd "name` string'
ROWS = [(i, None if i % 7 == 0 else "" if i % 5 == 0 else f"text '{i}' 研究", i / 3 if i % 4 else None, i % 3, None, "x") for i in range(-20, 300)]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "pages")
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("crawl_time", F.timestamp_seconds(F.lit(1704067200) + F.col("id"))).repartition(3)
    database.write_page_database(df, path)
    return df, database.read_page_database(spark, path, parts=4), f"{path}/x"


def rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip(both):
    df, stored, _ = both
    assert rows(stored) == rows(df.withColumn("processed", F.col("processed").cast("long")))
    assert stored.rdd.getNumPartitions() == 12  # ranges of three files


@pytest.mark.parametrize("where", ["id > 250", "id <= -5 or id = 3", "clean_text <> ''", "clean_text is null", "score >= 10.5 and processed = 1", "not processed in (0, 2)", "clean_text = 'text ''11'' 研究'"])
def test_conditions(spark, both, where):
    df, stored, _ = both
    want = rows(df.filter(where.replace("''11''", "\\'11\\'")).withColumn("processed", F.col("processed").cast("long")))
    assert rows(stored.filter(where.replace("''11''", "\\'11\\'"))) == want
    told = database.read_page_database(spark, both_path(both), parts=4, where=where)
    assert rows(told) == want


def both_path(both):
    return os.path.dirname(both[2])


def test_columns(spark, both):
    found = database.read_page_database(spark, both_path(both), columns=["id", "crawl_time"])
    assert found.dtypes == [("id", "bigint"), ("crawl_time", "timestamp")] and found.count() == len(ROWS)


def test_one_file_of_another_program(spark, tmp_path):
    file = str(tmp_path / "app.db")
    db = sqlite3.connect(file)
    db.execute("CREATE TABLE web_pages (id INTEGER PRIMARY KEY, url VARCHAR(2048), clean_text TEXT, publish_time TIMESTAMP, sensitivity_score FLOAT)")
    db.executemany("INSERT INTO web_pages VALUES (?, ?, ?, ?, ?)", [(1, "u", "t", "2024-01-05 03:04:05.000000", 0.5), (9, "v", None, None, None)])
    db.commit()
    db.close()
    found = pages.load_pages(database.read_page_database(spark, file)).collect()
    assert [(r.id, r.clean_text, str(r.publish_time), r.sensitivity_score) for r in found] == [(1, "t", "2024-01-05 03:04:05", 0.5)]


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "broken")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, clean_text string").coalesce(1)
    with pytest.raises(Exception, match="UNIQUE"):
        database.write_page_database(twice, path)
    assert not [n for n in os.listdir(path) if n.endswith(".sqlite")]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "empty")
    database.write_page_database(spark.createDataFrame([], "id long, clean_text string").repartition(1), path)
    assert database.read_page_database(spark, path).collect() == []
