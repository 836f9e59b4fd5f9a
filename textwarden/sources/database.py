"""Pages in SQLite files, read and written by many tasks.

A database is one file, or a folder of files that have the same table, which every executor can
open. Each file is read in ranges of its integer key, with the columns and the condition that were
asked for. (Spark 4.1 can push filters into a Python source, but a DataFrame then keeps those of its
first query for later ones, so a condition is given to the reader.) A job writes a file for each task; they get their names when all of them are done. Databases
with a server are read by Spark's own JDBC source, with the same ranges.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType, LongType, StringType, StructField, StructType

#: Rows in an Arrow batch; text columns may be long.
ROWS = 1000
TIMES = ("crawl_time", "publish_time")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Range(InputPartition):
    file: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, files: list[str], table: str, key: str, parts: int, where: str):
        self.schema, self.files, self.table, self.key, self.parts, self.where = schema, files, table, key, parts, where

    def partitions(self) -> list[Range]:
        out = []
        for file in self.files:
            with closing(opened(file)) as db:
                least, most = db.execute(f"SELECT min({quoted(self.key)}), max({quoted(self.key)}) FROM {quoted(self.table)}").fetchone()
            if least is not None:
                step = -(-(most - least + 1) // self.parts)
                out += [Range(file, at, min(most, at + step - 1)) for at in range(least, most + 1, step)]
        return out or [Range("", 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if not partition.file:
            return
        columns = ", ".join(quoted(n) for n in self.schema.names)
        where = f"{quoted(self.key)} BETWEEN ? AND ?" + f" AND ({self.where})" * bool(self.where)
        with closing(opened(partition.file)) as db:
            rows = db.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE {where}", [partition.first, partition.last])
            while part := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    draft: str


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, folder: str, table: str, key: str):
        self.schema, self.folder, self.table, self.key = schema, folder, table, key

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        draft = f"{self.folder}/.{uuid.uuid4().hex}"
        kinds = {f.name: "INTEGER" if isinstance(f.dataType, IntegralType | BooleanType) else "REAL" if isinstance(f.dataType, DoubleType | FloatType) else "TEXT" for f in self.schema.fields}
        with closing(sqlite3.connect(draft)) as db:
            columns = ", ".join(f"{quoted(n)} {k}{' PRIMARY KEY' * (n == self.key)}" for n, k in kinds.items())
            db.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
            for batch in batches:
                db.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(kinds))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
            db.commit()
        return Written(draft)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            os.rename(m.draft, f"{self.folder}/{os.path.basename(m.draft)[1:]}.sqlite")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.draft):
                os.remove(m.draft)


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


class PageDatabase(DataSource):
    """Options: ``path``, ``table`` (``web_pages``), ``key`` (``id``), ``parts``, ranges of each file (8), ``where``, a condition for the database."""

    @classmethod
    def name(cls) -> str:
        return "page_database"

    def _files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        return sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".sqlite")) if os.path.isdir(path) else [path]

    def schema(self) -> StructType:
        kinds = {"INTEGER": LongType(), "REAL": DoubleType(), "FLOAT": DoubleType()}
        files = self._files()
        if not files:
            raise FileNotFoundError(f"no database in {self.options['path']}")
        with closing(opened(files[0])) as db:
            rows = db.execute(f"PRAGMA table_info({quoted(self.options.get('table', 'web_pages'))})").fetchall()
        return StructType([StructField(r[1], kinds.get(r[2].upper(), StringType())) for r in rows])

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self._files(), self.options.get("table", "web_pages"), self.options.get("key", "id"), int(self.options.get("parts", "8")), self.options.get("where", ""))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options["path"].removeprefix("file://").removeprefix("file:"), self.options.get("table", "web_pages"), self.options.get("key", "id"))


def read_page_database(spark: SparkSession, path: str, table: str = "web_pages", key: str = "id", parts: int = 8, where: str = "", columns: list[str] | None = None) -> DataFrame:
    """The pages of a database that meet ``where``, told in its own SQL, with all or some ``columns``; times as timestamps."""
    spark.dataSource.register(PageDatabase)
    source = spark.read.format("page_database").options(path=path, table=table, key=key, parts=parts, where=where)
    if columns is not None:
        whole = source.load().schema
        source = source.schema(StructType([whole[c] for c in columns]))
    df = source.load()
    return df.withColumns({c: F.try_to_timestamp(F.substring(c, 1, 19)) for c in TIMES if c in df.columns and dict(df.dtypes)[c] == "string"})


def write_page_database(pages: DataFrame, path: str, table: str = "web_pages", key: str = "id") -> None:
    """Add pages to the database in the folder ``path``, a file for each task; times as text. A key must not be there twice in a task."""
    flat = pages.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, kind in pages.dtypes if kind.startswith("timestamp")})
    pages.sparkSession.dataSource.register(PageDatabase)
    flat.write.format("page_database").options(path=path, table=table, key=key).mode("append").save()
