"""Streaming forms of ingest, analysis and daily counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from textwarden.functions.text import build_pages
from textwarden.sources.keyed import KeyedTable


def ingest(raw: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """A stream of raw pages (``url``, ``raw_html``, ``crawl_time``) as cleaned pages, the first of each URL.

    With a ``delay`` the URLs remembered as state are those of the delay behind the newest
    ``crawl_time``; ``run_into`` a table by ``url`` holds those that come back later against what is
    stored. Without one, for rows that carry no time, all of them are state.
    """
    if delay is None:
        return build_pages(raw).dropDuplicates(["url"])
    return build_pages(raw.withWatermark("crawl_time", delay)).dropDuplicatesWithinWatermark(["url"])


def run_available(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None, timeout: int = 600) -> None:
    """Process what is there and stop. ``each`` turns a micro-batch into what is appended; a batch that is run again replaces its own folder."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if each is None:
        query: StreamingQuery = writer.format("parquet").outputMode("append").start(path)
    else:
        query = writer.foreachBatch(lambda df, n: each(df).write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout} s")


def run_into(stream: DataFrame, path: str, key: str, checkpoint: str, name: str, each: Callable[[DataFrame], DataFrame] | None = None, insert: bool = False, buckets: int = 64, timeout: int = 600) -> None:
    """Process what is there into the keyed table at ``path`` and stop; a row takes the place of that with its key, or, with ``insert``, stays out.

    ``name`` is the stream's in the table: a micro-batch that is run again after a failure finds
    its number there and changes nothing. State of the stream is kept in RocksDB, on disk.
    """

    def put(df: DataFrame, number: int) -> None:
        table = KeyedTable(df.sparkSession, path, key, buckets)
        write = table.insert if insert else table.merge
        write(each(df) if each else df, source=name, number=number)

    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout} s")


def time_counts(events: DataFrame, column: str = "ts", window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows of each window; in append mode a window comes out once the watermark has passed its end, and what comes later is dropped."""
    span = F.window(column, window, slide) if slide else F.window(column, window)
    return events.withWatermark(column, delay).groupBy(span.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
