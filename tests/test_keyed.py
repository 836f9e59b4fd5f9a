"""The keyed table against a plain dictionary, its versions, and how Spark reads it."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textwarden.operators import sites
from textwarden.plans import analysis
from textwarden.sources.keyed import Conflict, KeyedTable
from textwarden.streaming import jobs

SCHEMA = "id long, n long, v string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def rows(table, number=None):
    found = table.read(number)
    return {} if found is None else {r.id: (r.n, r.v) for r in found.collect()}


def test_against_a_dictionary(spark, path):
    rnd, kept, versions = random.Random(4), {}, [{}]
    table = KeyedTable(spark, path, "id", 4)
    for step in range(7):
        batch = [(rnd.randrange(60), rnd.randrange(5), f"{step}-{i}") for i in range(rnd.choice([1, 4, 40]))]
        first: dict[int, tuple] = {}
        for k, n, v in sorted(batch, key=lambda r: (-r[1], r[2])):
            first.setdefault(k, (n, v))
        df = spark.createDataFrame(batch, SCHEMA).repartition(3)
        order = [F.desc("n"), F.col("v")]
        if rnd.random() < 0.6:
            table.merge(df, order)
            kept |= first
        else:
            table.insert(df, order)
            kept = first | kept
        versions.append(dict(kept))
        assert rows(KeyedTable(spark, path, "id")) == kept
    assert [rows(table, n) for n in range(len(versions))] == versions
    stored = {r.id for r in table.stored_keys(spark.range(80)).collect()}
    assert stored == set(kept)
    asked = spark.createDataFrame([(k, 0, "x") for k in [*range(0, 80, 3), None]], SCHEMA)
    assert {r.id for r in table.without(asked).collect()} == {k for k in [*range(0, 80, 3), None] if k not in kept}
    assert {r.id for r in table.having(asked).collect()} == {k for k in range(0, 80, 3) if k in kept}
    table.vacuum(keep=1)
    assert rows(table) == kept and len(table.folder.names("versions")) == 1


def test_two_batches_of_one_site(spark, path):
    """A second batch leaves the site's other pages alone."""
    site = lambda *ids: spark.createDataFrame([(i, "a", [f"flag{len(ids)}"]) for i in ids], "id long, source_site string, flags array<string>")
    analysis.write_analysis(site(1, 2, 3), path, buckets=4)
    analysis.write_analysis(site(3, 4), path, buckets=4)
    found = analysis.analysis_store(spark, path).read().collect()
    assert sorted((r.id, r.flags) for r in found) == [(1, '["flag3"]'), (2, '["flag3"]'), (3, '["flag2"]'), (4, '["flag2"]')]


def test_reader_keeps_its_version(spark, path):
    table = KeyedTable(spark, path, "id", 4)
    table.merge(spark.createDataFrame([(i, 1, "old") for i in range(50)], SCHEMA))
    before = table.read()
    table.merge(spark.createDataFrame([(i, 2, "new") for i in range(25, 75)], SCHEMA))
    assert {r.v for r in before.collect()} == {"old"} and before.count() == 50
    assert table.read().groupBy("v").count().orderBy("v").collect() == [("new", 50), ("old", 25)]


def test_second_writer_fails_and_nothing_is_lost(spark, path):
    one, two = KeyedTable(spark, path, "id", 4), KeyedTable(spark, path, "id", 4)
    one.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA))
    base = two.version()
    one.merge(spark.createDataFrame([(2, 1, "b")], SCHEMA))
    with pytest.raises(Conflict):
        two._publish(base, [], {})
    assert rows(two) == {1: (1, "a"), 2: (1, "b")}


def test_unfinished_write_is_not_seen(spark, path):
    table = KeyedTable(spark, path, "id", 4)
    table.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA))
    table._write(spark.createDataFrame([(1, 2, "b"), (9, 2, "b")], SCHEMA), replaces=True)  # a writer that died before its version
    assert rows(table) == {1: (1, "a")}
    with pytest.raises(PySparkException):
        table.merge(spark.createDataFrame([(None, 1, "no key")], SCHEMA))
    assert rows(table) == {1: (1, "a")}


def test_repeated_batch_of_a_stream(spark, path):
    table, batch = KeyedTable(spark, path, "id", 4), spark.createDataFrame([(1, 1, "a")], SCHEMA)
    assert table.merge(batch, source="s", number=0)
    assert not table.merge(batch.withColumn("v", F.lit("again")), source="s", number=0)
    assert table.merge(batch.withColumn("v", F.lit("next")), source="s", number=1)
    assert rows(table) == {1: (1, "next")}


def test_empty_batches_and_another_key(spark, path):
    table = KeyedTable(spark, path, "id", 4)
    assert table.read() is None and table.stored_keys(spark.range(3)).collect() == []
    table.merge(spark.createDataFrame([], SCHEMA))
    table.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA))
    table.insert(spark.createDataFrame([], SCHEMA))
    assert rows(table) == {1: (1, "a")}
    with pytest.raises(ValueError):
        KeyedTable(spark, path, "v")


def test_new_columns(spark, path):
    table = KeyedTable(spark, path, "id", 2)
    table.merge(spark.createDataFrame([(i, 1, "a") for i in range(40)], SCHEMA))
    table.merge(spark.createDataFrame([(1, 2.5)], "id long, score double"))
    found = {r.id: r for r in table.read().collect()}
    assert found[1].score == 2.5 and found[1].v is None and found[2].v == "a" and found[2].score is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_side_is_not_moved(spark, path, monkeypatch):
    """Without broadcasts, levels are joined and keys are found without an exchange above a stored file."""
    table = KeyedTable(spark, path, "id", 4)
    table.merge(spark.createDataFrame([(i, 1, "a") for i in range(400)], SCHEMA))
    table.merge(spark.createDataFrame([(i, 2, "b") for i in range(390, 410)], SCHEMA))
    assert len(table.version().levels) == 2
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(table.read()) and "Exchange" not in plan(table.read())
        monkeypatch.setattr("textwarden.sources.keyed.MAX_WORDS", 0)
        found = table.stored_keys(spark.range(380, 420))
        tree = plan(found)
        for part in tree.split("Exchange")[1:]:  # what is below an exchange reads the asked keys, or what has been joined already
            assert "keyed_" not in part or "SortMergeJoin" in part
        assert {r.id for r in found.collect()} == set(range(380, 410))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_buckets_that_may_hold_a_key_are_read(spark, path):
    table = KeyedTable(spark, path, "url", 16)
    stored = spark.range(3000).select(F.concat(F.lit("http://a.example/"), F.col("id").cast("string")).alias("url"))
    table.insert(stored)
    fresh = spark.range(3000).select(F.concat(F.lit("http://b.example/"), F.col("id").cast("string")).alias("url"))
    assert table.candidates(fresh, table.version()).count() < 30  # false alarms
    one = stored.limit(1)
    files = table.stored_keys(one).inputFiles()
    assert sum("/rows/" in f for f in files) == 1
    assert sites.new_urls(fresh.unionByName(one), table).count() == 3000 and sites.known_urls(fresh.unionByName(one), table).collect() == one.collect()


def test_url_that_comes_back_after_the_delay(spark, tmp_path):
    schema, source = "url string, raw_html string, crawl_time timestamp", str(tmp_path / "in")
    page = lambda u, t, when: (u, f"<p>{t * 60}</p>", when)
    batches = [[page("u", "a", "2024-01-01"), page("v", "b", "2024-01-02")], [page("w", "c", "2024-02-01")], [page("u", "z", "2024-03-01"), page("x", "d", "2024-03-01")]]
    for batch in batches:
        spark.createDataFrame(batch, "url string, raw_html string, crawl_time string").withColumn("crawl_time", F.col("crawl_time").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.ingest(spark.readStream.schema(schema).parquet(source), "1 day")
        jobs.run_into(stream, str(tmp_path / "out"), "url", str(tmp_path / "state"), "ingest", insert=True, buckets=4)
    found = {r.url: r.clean_text[0] for r in KeyedTable(spark, str(tmp_path / "out"), "url").read().collect()}
    assert found == {"u": "a", "v": "b", "w": "c", "x": "d"}
