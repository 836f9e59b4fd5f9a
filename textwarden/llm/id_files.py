"""Token ids in binary shard files with a minimal perfect hash index.

A shard holds the documents of one range of keys, in ascending order. ``shard-N.ids`` is the raw
payload: all ids as little-endian 16-bit integers. ``shard-N.idx`` is its index: a header
(``HEADER``), the null keys' count, then three arrays: the displacements of the minimal perfect
hash, and by slot a 32-bit fingerprint of the key with the first of its documents, and by
document where it starts in the payload. A lookup hashes the key once for its bucket and once,
with the bucket's displacement, for its slot; a fingerprint that differs means that the key is
not there. Files are written beside their place and moved into it, so a repeated task does no harm.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm.ranges import range_bounds, range_bucket
from textwarden.llm.token_ids import crc32, ids_column, small_batches
from textwarden.runtime import materialise, scratch

#: Magic, keys, buckets, documents, null keys.
HEADER = struct.Struct("<8sqqqq")
MAGIC = b"IDSHARD1"
KEYS_PER_BUCKET = 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) of integer keys under a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype("u8") + (np.asarray(seed).astype("u8") + np.uint64(1)) * _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0x5EED) >> np.uint64(32)).astype("u4")


def build_index(keys: np.ndarray) -> np.ndarray:
    """Displacements that send the distinct ``keys`` to 0 .. len(keys) - 1 without a collision. A negative one is a slot itself."""
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    shift = np.zeros(buckets, "i8")
    where = (mix(keys, 0) % np.uint64(buckets)).astype("i8")
    order = np.argsort(where, kind="stable")
    sizes = np.bincount(where, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    taken = np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size[sizes[by_size] > 1]:
        own = keys[order[starts[b] : starts[b + 1]]]
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64)
            slots = (mix(own[None, :], tries[:, None]) % np.uint64(n)).astype("i8")
            clear = ~taken[slots].any(axis=1)
            for t in np.flatnonzero(clear):
                if len(np.unique(slots[t])) == len(own):
                    shift[b] = tries[t]
                    taken[slots[t]] = True
                    break
            else:
                seed += 64
                continue
            break
    shift[by_size[sizes[by_size] == 1]] = -np.flatnonzero(~taken)[: (sizes == 1).sum()] - 1
    return shift


def slots_of(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    d = shift[(mix(keys, 0) % np.uint64(len(shift))).astype("i8")]
    return np.where(d < 0, -d - 1, (mix(keys, np.maximum(d, 0)) % np.uint64(max(n, 1))).astype("i8"))


def pack_index(keys: list[int | None], lengths: list[int]) -> bytes:
    """The index of documents with these keys, nulls first and equal keys together."""
    nulls = sum(k is None for k in keys)
    distinct, first = np.unique(np.array(keys[nulls:], "i8"), return_index=True)
    shift = build_index(distinct)
    slots = slots_of(distinct, shift, len(distinct))
    prints, firsts = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8")
    prints[slots], firsts[slots] = fingerprint(distinct), first + nulls
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    head = HEADER.pack(MAGIC, len(distinct), len(shift), len(keys), nulls)
    return head + b"".join(a.tobytes() for a in (shift.astype("<i8"), prints, firsts, starts))


class Shard:
    """A shard opened for keyed access."""

    def __init__(self, folder: str, shard: int):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{base}/shard-{shard}.idx") as f:
            data = f.read()
        magic, self.keys, buckets, documents, self.nulls = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"shard {shard} of {folder} has no index of this kind")
        at, arrays = HEADER.size, []
        for kind, n in (("<i8", buckets), ("<u4", self.keys), ("<i8", self.keys), ("<i8", documents + 1)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        self.shift, self.prints, self.firsts, self.starts = arrays
        self.payload = fs.open_input_file(f"{base}/shard-{shard}.ids")

    def find(self, keys: list[int | None]) -> list[int]:
        """The position of each key's first document, or -1."""
        null = [k is None for k in keys]
        given = np.array([0 if k is None else k for k in keys], "i8")
        if not self.keys:
            return [0 if n and self.nulls else -1 for n in null]
        slots = slots_of(given, self.shift, self.keys)
        found = np.where(self.prints[slots] == fingerprint(given), self.firsts[slots], -1)
        return np.where(null, 0 if self.nulls else -1, found).tolist()

    def ids(self, position: int) -> np.ndarray:
        start, end = int(self.starts[position]), int(self.starts[position + 1])
        self.payload.seek(2 * start)
        return np.frombuffer(self.payload.read(2 * (end - start)), "<u2").astype("<u4")


class _File:
    """A file that is written beside its place and moved into it when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, base = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.part, self.place = f"{base}/.{name}-{uuid.uuid4().hex}", f"{base}/{name}"
        self.stream = self.fs.open_output_stream(self.part, buffer_size=2**20)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.place)


def _with_scheme(spark: SparkSession, folder: str) -> str:
    """``folder`` on the file system that Spark itself would take."""
    if "://" in folder:
        return folder
    home = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return f"file://{folder}" if home.startswith("file:") else f"{home.rstrip('/')}{folder}"


def write_ids(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", rows_per_shard: int = 2000, folder: str | None = None) -> tuple[str, DataFrame, list[int]]:
    """Encode the texts (null: empty), append ``end_id``, and write the shards.

    Gives the folder, the manifest (``shard``, ``documents``, ``tokens``, ``start``: ids before
    the shard) and the keys at which a new shard begins. Null keys come first and are kept
    without an index entry; of equal keys the index has the first, the others follow it.
    """
    small_batches(df.sparkSession)
    folder = folder or scratch(df.sparkSession, "ids")
    folder = _with_scheme(df.sparkSession, folder)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    bounds = range_bounds(rows.select("key"), "key", rows_per_shard)
    coded = rows.select("key", range_bucket(F.col("key"), bounds).alias("shard"), ids_column(F.col("text"), tokenizer, end_id).alias("ids"))
    dealt = coded.repartition("shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, payload, keys, lengths = None, None, [], []  # the ids themselves go to the file as they come

        def close() -> pa.RecordBatch:
            payload.close()
            index = _File(folder, f"shard-{shard}.idx")
            index.stream.write(pack_index(keys, lengths))
            index.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "documents": [len(keys)], "tokens": [sum(lengths)]})

        for batch in batches:
            for k, s, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard:
                    if keys:
                        yield close()
                    shard, payload, keys, lengths = s, _File(folder, f"shard-{s}.ids"), [], []
                payload.stream.write(ids)
                keys.append(k)
                lengths.append(len(ids) // 2)
        if keys:
            yield close()

    manifest = dealt.mapInArrow(write, "shard int, documents bigint, tokens bigint")
    manifest = materialise(manifest, "id-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), bounds


def read_ids(keys: DataFrame, folder: str, manifest: DataFrame, bounds: list[int], key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """For each row of ``keys``, by keyed access: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before. The n-th row of a repeated key gets the
    key's n-th document; a key that the files don't have gets nulls.
    """
    rows = keys.select(F.col(f"`{key}`").cast("long").alias("key"))
    rows = rows.withColumn("shard", range_bucket(F.col("key"), bounds)).join(manifest.select("shard", "start"), "shard", "left")
    # As many tasks as shards, so that adaptive execution doesn't bring all these small rows, whose ids are not small, to one.
    rows = rows.select("shard", "key", "start").repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first())
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []
    schema = pa.schema(fields)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shard, last, seen = None, None, object(), 0
        for batch in batches:
            out = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for s, own in itertools.groupby(rows, lambda row: row[0]):
                own = list(own)
                if s != shard:
                    shard, opened, last = s, Shard(folder, s) if own[0][2] is not None else None, object()
                places = opened.find([k for _, k, _ in own]) if opened else [-1] * len(own)
                for (_, k, start), at in zip(own, places, strict=True):
                    seen = seen + 1 if k == last else 0
                    last = k
                    if at < 0 or at + seen >= len(opened.starts) - 1:
                        out.append((k,) + (None,) * (len(fields) - 1))
                        continue
                    ids = opened.ids(at + seen)
                    out.append((k, start + int(opened.starts[at + seen]), len(ids), crc32(ids)) + ((ids.tolist(),) if with_ids else ()))
            columns = list(zip(*out, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(look, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else ""))
