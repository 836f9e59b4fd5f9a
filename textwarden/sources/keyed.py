"""A table with one row for each key, kept in files by hash of the key.

A version of the table is a list of levels, newest first; each is a folder of Parquet files, one for
each hash bucket, sorted by key, so that Spark joins levels, and levels with what is dealt the same
way, without moving the stored side. A row of a newer level replaces that of an older one. Versions
are small JSON files of which each is put in place by one rename, which fails if another writer was
first: a reader sees one whole version, a writer that died leaves the last one as it was. Small
levels are folded into the next when they have grown to a part of it, so that a row is rewritten
as often as the logarithm of the table.

A Bloom filter of each bucket tells which stored files may hold a key at all.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textwarden.runtime import MAX_WORDS, materialise

#: A level is folded into the newer one that has at least this part of its rows; bits for each key of a filter, and how many of them a key sets.
FOLD, BITS, HASHES = 0.25, 12, 6


@dataclass
class Level:
    folder: str
    rows: int
    schema: str
    replaces: bool  # whether older levels may have rows of its keys


@dataclass
class Version:
    number: int
    key: str
    buckets: int
    levels: list[Level] = field(default_factory=list)
    applied: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


class Folder:
    """Files of a folder through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.gateway, self.conf = spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.fs_package = spark._jvm.org.apache.hadoop.fs
        root = self.fs_package.Path(path)
        self.fs = root.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(root).toString()

    def path(self, name: str):
        return self.fs_package.Path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that isn't there yet, whole or not at all."""
        draft = self.path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.fs_package.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(draft, self.path(name), self.gateway.new_array(self.fs_package.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(draft, False)
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits, a power of two."""
    h = hashes.view("u8")
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype="u8") * high[:, None]) & np.uint64(size - 1)).astype("i8")


class KeyedTable:
    """The table at ``path`` with one row for each value of ``key``. ``buckets`` holds for a new table; an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.folder = spark, Folder(spark, path)
        found = self.version()
        if found.number and found.key != key:
            raise ValueError(f"the table's key is {found.key}, not {key}")
        self.key, self.buckets = key, found.buckets if found.number else buckets

    # Versions

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of ``number``; number 0, without levels, before the first write."""
        known = sorted(int(n[:-5]) for n in self.folder.names("versions") if re.fullmatch(r"\d+\.json", n))
        wanted = number if number is not None else known[-1] if known else 0
        if not wanted:
            return Version(0, getattr(self, "key", ""), getattr(self, "buckets", 0))
        saved = json.loads(self.folder.text(f"versions/{wanted:08d}.json"))
        return Version(**saved | {"levels": [Level(**x) for x in saved["levels"]]})

    def _publish(self, base: Version, levels: list[Level], applied: dict[str, int]) -> None:
        new = Version(base.number + 1, self.key, self.buckets, levels, applied)
        self.folder.put(f"versions/{new.number:08d}.json", json.dumps(asdict(new)))

    def vacuum(self, keep: int = 2) -> None:
        """Delete levels and versions that the last ``keep`` versions don't use. No writer and no older reader may be at work."""
        newest = self.version().number
        kept = range(max(1, newest - keep + 1), newest + 1)
        used = {x.folder for n in kept for x in self.version(n).levels}
        for name in self.folder.names("levels"):
            if f"levels/{name}" not in used:
                self.folder.delete(f"levels/{name}")
        for name in self.folder.names("versions"):
            if re.fullmatch(r"\d+\.json", name) and int(name[:-5]) not in kept:
                self.folder.delete(f"versions/{name}")

    # Reading

    def _bucketed(self, level: Level) -> DataFrame:
        """A level whose buckets Spark knows. The catalog has it only until it is resolved."""
        name = f"keyed_{uuid.uuid4().hex}"
        columns = StructType.fromJson(json.loads(level.schema))
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in columns.fields)
        place = f"{self.folder.root}/{level.folder}/rows".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        try:
            return self.spark.table(name).select("*")
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _rows(self, levels: list[Level]) -> DataFrame | None:
        """The newest row of each key of ``levels``. Levels are joined bucket by bucket, without an exchange."""
        out, newer = None, []
        for level in levels:
            rows = self._bucketed(level)
            left = rows
            for n in newer:
                left = left.join(n, self.key, "left_anti")
            out = left if out is None else out.unionByName(left, allowMissingColumns=True)
            if level.replaces:
                newer.append(rows.select(self.key))
        return out

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of the newest version, or of version ``number``; None before the first write."""
        return self._rows(self.version(number).levels)

    # Writing

    def _one_each(self, batch: DataFrame, order: list[Column]) -> DataFrame:
        """The first row of each key by ``order``, then by a hash of its content; in the table's buckets. A null key ends the job."""
        key = F.col(self.key)
        checked = batch.withColumn(self.key, F.when(key.isNotNull(), key).otherwise(F.raise_error(F.lit(f"a row without {self.key}")).cast(batch.schema[self.key].dataType)))
        content = F.xxhash64(*(c for c, kind in batch.dtypes if "map<" not in kind and "variant" not in kind))
        nth = F.row_number().over(Window.partitionBy(self.key).orderBy(*order, content))
        return checked.repartition(self.buckets, self.key).withColumn("__nth", nth).filter("__nth = 1").drop("__nth")

    def _write(self, rows: DataFrame, replaces: bool) -> Level:
        folder = f"levels/{uuid.uuid4().hex}"
        place, name = f"{self.folder.root}/{folder}/rows", f"keyed_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", place).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
        schema = StructType.fromJson(rows.schema.jsonValue())
        for f in schema.fields:
            f.nullable, f.metadata = True, {}
        level = Level(folder, 0, schema.json(), replaces)
        stored = self.spark.read.schema(schema).parquet(place).select(self.key)
        level.rows = stored.count()  # from the footers
        self._filters(stored, level)
        return level

    def _filters(self, stored: DataFrame, level: Level) -> None:
        """Bloom filters of the level's buckets; a bucket that several tasks read has several, of which each holds a part."""
        size = 1 << max(10, int(BITS * max(1, level.rows) / self.buckets).bit_length())

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                bucket, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for b in np.unique(bucket).tolist():
                    bits = found.setdefault(b, np.zeros(size, bool))
                    bits[positions(h[bucket == b], size).ravel()] = True
            for b, bits in found.items():
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        stored.select(self._bucket(), F.xxhash64(self.key).alias("h")).mapInArrow(build, "bucket int, bits binary").write.parquet(f"{self.folder.root}/{level.folder}/filters")

    def _bucket(self) -> Column:
        """The number of the file that Spark writes a key to."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def merge(self, batch: DataFrame, order: list[Column] = (), source: str | None = None, number: int | None = None) -> bool:
        """Put the rows of ``batch`` in place of those with their keys; of several with a key the first by ``order`` counts.

        A batch ``number`` of a ``source`` that has been merged, or a later one, is left out, so that
        a stream may repeat its last batch. Returns whether a version was written.
        """
        base = self.version()
        if source is not None and base.applied.get(source, -1) >= number:
            return False
        level = self._write(self._one_each(batch, list(order)), replaces=bool(base.levels))
        levels = [level, *base.levels]
        if level.rows == 0 and base.levels:
            levels = base.levels
        self._publish(base, self._folded(levels), base.applied | ({source: number} if source is not None else {}))
        return True

    def insert(self, batch: DataFrame, order: list[Column] = (), source: str | None = None, number: int | None = None) -> bool:
        """Add the rows whose keys the table doesn't have; of several with a key the first by ``order``. ``source`` and ``number`` as in ``merge``."""
        base = self.version()
        if source is not None and base.applied.get(source, -1) >= number:
            return False
        fresh = self._one_each(batch, list(order))
        if base.levels:
            fresh = self.without(materialise(fresh, "batch"), base)
        level = self._write(fresh, replaces=False)
        levels = [level, *base.levels] if level.rows or not base.levels else base.levels
        self._publish(base, self._folded(levels), base.applied | ({source: number} if source is not None else {}))
        return True

    def _folded(self, levels: list[Level]) -> list[Level]:
        """The newest levels as one, as far as each is not much larger than those before it together."""
        n, rows = 1, levels[0].rows if levels else 0
        while n < len(levels) and rows >= FOLD * levels[n].rows:
            rows += levels[n].rows
            n += 1
        if n == 1:
            return levels
        older = levels[n:]
        return [self._write(self._rows(levels[:n]), replaces=bool(older) and any(x.replaces for x in levels[:n])), *older]

    # Which keys are stored

    def candidates(self, keys: DataFrame, version: Version) -> DataFrame:
        """``key``, ``level``, ``bucket`` of each of ``keys`` (distinct) and level whose filter doesn't rule it out."""
        filters = None
        for i, level in enumerate(version.levels):
            f = self.spark.read.schema("bucket int, bits binary").parquet(f"{self.folder.root}/{level.folder}/filters").withColumn("level", F.lit(i))
            filters = f if filters is None else filters.unionByName(f)
        asked = keys.select(F.col(self.key).alias("key"), self._bucket(), F.xxhash64(self.key).alias("h"))
        kind = keys.schema[self.key].dataType.simpleString()

        def test(asked: pa.Table, filters: pa.Table) -> pa.Table:
            h, merged, out = asked["h"].to_numpy(), {}, []
            for bits, level in zip(filters["bits"], filters["level"].to_pylist(), strict=True):
                part = np.frombuffer(bits.as_buffer(), "u1")
                merged[level] = part if level not in merged else merged[level] | part
            for level, bits in merged.items():
                at = positions(h, 8 * len(bits))
                hit = np.flatnonzero(((bits[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1))
                rows = asked.take(pa.array(hit))
                out.append(pa.table({"key": rows["key"], "level": pa.array(np.full(len(hit), level, "i4")), "bucket": rows["bucket"]}))
            return pa.concat_tables(out) if out else pa.table({"key": asked["key"].slice(0, 0), "level": pa.array([], pa.int32()), "bucket": asked["bucket"].slice(0, 0)})

        return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, f"key {kind}, level int, bucket int")

    def stored_keys(self, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """Those of ``keys`` (one column, distinct) that the table has.

        Filters name the buckets that may hold a key. Where few keys are left, these are broadcast to
        the files of those buckets alone; else the levels are joined bucket by bucket. The stored side
        is never moved.
        """
        version = version or self.version()
        empty = keys.limit(0)
        if not version.levels:
            return empty
        maybe = materialise(self.candidates(keys, version), "maybe-stored")
        found = {(r["level"], r["bucket"]): r["n"] for r in maybe.groupBy("level", "bucket").agg(F.count("*").alias("n")).collect()}  # a row for each file at most
        out = empty
        for i, level in enumerate(version.levels):
            buckets = {b for (at, b) in found if at == i}
            if not buckets:
                continue
            asked = maybe.filter(F.col("level") == i).select(F.col("key").alias(self.key))
            if sum(n for (at, _), n in found.items() if at == i) <= MAX_WORDS:
                names = [n for n in self.folder.names(f"{level.folder}/rows") if (m := re.search(r"_(\d{5})\.", n)) and int(m[1]) in buckets]
                stored = self.spark.read.schema(StructType.fromJson(json.loads(level.schema))).parquet(*(f"{self.folder.root}/{level.folder}/rows/{n}" for n in names))
                met = stored.select(self.key).join(F.broadcast(asked), self.key, "left_semi")
            else:
                met = self._bucketed(level).select(self.key).join(asked.repartition(self.buckets, self.key), self.key, "left_semi")
            out = out.unionByName(met)
        return out.distinct() if any(x.replaces for x in version.levels) else out

    def without(self, rows: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows whose key the table doesn't have, null keys among them."""
        return rows.join(self.stored_keys(rows.select(self.key).filter(F.col(self.key).isNotNull()).distinct(), version), self.key, "left_anti")

    def having(self, rows: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows whose key the table has."""
        return rows.join(self.stored_keys(rows.select(self.key).filter(F.col(self.key).isNotNull()).distinct(), version), self.key, "left_semi")
