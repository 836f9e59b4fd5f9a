"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Two suffixes that agree in their first ``width`` bytes are a repeat; how they go on does not
matter, so the sort ends there. It runs by passes from the most significant digit on, and what is
alone in its group after a pass leaves:

1. Every window of ``width`` bytes contains an anchor, its smallest ``K``-gram (see ``repeats``),
   at which equal windows agree. The first digit is the anchor: windows at ``K`` bytes that
   occur once in the corpus are unique. Consecutive windows of one anchor go on as a range.
2. Anchors with up to ``HOT`` ranges are brought together with their bytes. Equal ranges are
   repeats as a whole; the windows of the others are sorted eight bytes at a time.
3. Anchors with more ranges are sorted by Spark: each pass halves the ranges, so that all windows
   of the left half share more bytes to the right of the anchor and those of the right half more
   to its left, and those bytes are the next digit. Equal parts are counted with partial
   aggregation, so copies, however many, go on as one; groups that have become small go to 2.

Hashes only deal rows to groups; what is reported as a repeat has been compared byte by byte.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.repeats import ranges, repeated
from textwarden.llm.skew import spread_join
from textwarden.llm.token_ids import small_batches
from textwarden.runtime import materialise

K = 40
#: Ranges of one anchor that one task brings together, and bytes of ranges that it sorts at once.
HOT, BLOCK = 2000, 2**21


def _name(key: Column, text: Column) -> Column:
    hashed = F.xxhash64(key.cast("long"), F.coalesce(text, F.lit("")))
    return hashed.bitwiseAND(F.lit(-2)).bitwiseOR(key.isNull().cast("long"))


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows named by their key and a hash of key and text, which is odd for null keys; repeated rows have one name and one result."""
    name = _name(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("id"), name.alias("hash"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def _grams(docs: DataFrame, width: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranges(np.frombuffer(t.encode(), "u1"), width, k)[2] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(np.concatenate(found) if found else [], pa.int64())})

    return docs.select("text").mapInArrow(run, "gram bigint")


def _ranges(docs: DataFrame, width: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "text")), strict=True):
                first, last, gram, anchor = ranges(np.frombuffer(t.encode(), "u1"), width, k)
                for column, values in zip(out, (np.full(len(first), i), np.full(len(first), h), gram, first, last - first, anchor - first), strict=True):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()).cast(t) for c, t in zip(out, [pa.int64()] * 4 + [pa.int32()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "hash", "gram", "base", "more", "anchor"])

    return docs.mapInArrow(run, "id bigint, hash bigint, gram bigint, base bigint, more int, anchor int")


def _sorted_block(table: pa.Table, width: int) -> pa.Table:
    """Repeated stretches in the ranges of some groups, all of whose rows are in ``table``."""
    data = table["data"].combine_chunks()
    group = np.unique(table["grp"].to_numpy(), return_inverse=True)[1]
    coded = data.dictionary_encode()
    kind = group * len(coded.dictionary) + coded.indices.to_numpy()
    _, rep, kind, times = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
    alone, base, size = table["alone"].to_numpy(zero_copy_only=False), table["base"].to_numpy(), np.diff(np.frombuffer(data.buffers()[1], "i4")[data.offset : data.offset + len(data) + 1])
    whole = np.flatnonzero(alone & (times[kind] > 1))
    single = (times == 1) & alone[rep]
    mixed = np.bincount(group[rep], single, minlength=group.max(initial=-1) + 1) > 0
    rows = rep[mixed[group[rep]]]  # one of each kind, where some kind is single
    starts = np.frombuffer(data.buffers()[1], "i4")[data.offset : data.offset + len(data)].astype("i8")
    count = size[rows] - width + 1
    of = np.repeat(np.arange(len(rows)), count)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    label = group[rows][of] * (1 << 20) + table["anchor"].to_numpy()[rows][of] - shift
    again = repeated(np.frombuffer(data.buffers()[2], "u1") if len(rows) else np.zeros(0, "u1"), starts[rows][of] + shift, label, width)
    again &= single[kind[rows]][of]
    begin, end = _runs(again, of)
    out = {c: np.concatenate([table[c].to_numpy()[whole], table[c].to_numpy()[rows[of[begin]]]]) for c in ("id", "hash")}
    out["start"] = np.concatenate([base[whole], base[rows[of[begin]]] + shift[begin]])
    out["end"] = np.concatenate([base[whole] + size[whole], base[rows[of[begin]]] + shift[end] + width])
    return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})


def _runs(hit: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of hits that belong to one row."""
    same = of[1:] == of[:-1]
    before = np.concatenate([[False], hit[:-1] & same]) if len(hit) else hit
    after = np.concatenate([hit[1:] & same, [False]]) if len(hit) else hit
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)


def _sorted_groups(rows: DataFrame, width: int) -> DataFrame:
    """Repeated stretches (``id``, ``hash``, ``start``, ``end``) in the ranges of groups ``grp`` of at most ``HOT`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) < BLOCK:
                continue
            table = pa.Table.from_batches(held)
            groups = table["grp"].to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if cut:
                yield from _sorted_block(table.slice(0, cut), width).to_batches()
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from _sorted_block(pa.Table.from_batches(held), width).to_batches()

    dealt = rows.select("grp", "id", "hash", "base", "anchor", "data", "alone").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "id bigint, hash bigint, start bigint, end bigint")


def _halves(rows: DataFrame, width: int) -> DataFrame:
    """The ranges of each group in two parts, by the distance from window to anchor (``low`` to ``high``), dealt to groups by the bytes that all windows of the part must share beyond those before (``left`` of the anchor, ``right`` from it on)."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    near_ = F.struct(F.col("low").alias("low"), middle.alias("high"), F.col("left").alias("left"), (F.lit(width) - middle).alias("right"))
    far = F.struct((middle + 1).alias("low"), F.col("high").alias("high"), (middle + 1).alias("left"), F.col("right").alias("right"))
    parts = rows.withColumn("part", F.explode(F.array(near_, far)))
    skip = F.greatest(F.lit(0), F.col("anchor") - F.col("part.high"))
    last = F.least(F.octet_length("data") - width, F.col("anchor") - F.col("part.low"))
    parts = parts.withColumns({"skip": skip, "last": last}).filter("skip <= last")
    more_right = F.substring(F.col("data"), F.col("anchor") + F.col("right") + 1, F.col("part.right") - F.col("right"))
    more_left = F.substring(F.col("data"), F.col("anchor") - F.col("part.left") + 1, F.col("part.left") - F.col("left"))
    digit = F.when(F.col("part.right") > F.col("right"), more_right).otherwise(more_left)
    return parts.select(
        F.xxhash64("grp", F.col("part.low"), digit).alias("grp"), "id", "hash", (F.col("base") + F.col("skip")).alias("base"), (F.col("anchor") - F.col("skip")).alias("anchor"),
        F.substring(F.col("data"), F.col("skip") + 1, F.col("last") - F.col("skip") + width).alias("data"), "alone", "part.*",
    )


def _hot_groups(rows: DataFrame, width: int, k: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Repeated stretches in the ranges of groups of any size, and the groups that have become small enough for ``_sorted_groups``."""
    spans, small = [], []
    rows = rows.select("*", F.lit(0).alias("low"), F.lit(width - k).alias("high"), F.lit(0).alias("left"), F.lit(k).alias("right"))
    rows = materialise(rows, "hot-ranges")
    while not rows.isEmpty():
        kept = [c for c in rows.columns if c not in ("grp", "data", "alone")]
        kinds = rows.groupBy("grp", "data").agg(F.count("*").alias("times"), F.bool_and("alone").alias("alone"), *(F.first(c).alias(c) for c in kept))
        kinds = materialise(kinds, "hot-kinds")
        kind = F.xxhash64("grp", "data").alias("kind")
        several = kinds.filter("times > 1").select(kind, F.col("data").alias("same"), F.col("grp").alias("of"))
        met = spread_join(rows.filter("alone").select("*", kind), several, "kind").filter("data = same and grp = of")
        spans.append(materialise(met.select("id", "hash", F.col("base").alias("start"), (F.col("base") + F.octet_length("data")).alias("end")), "hot-spans"))
        single = F.col("alone") & (F.col("times") == 1)
        groups = kinds.groupBy("grp").agg(F.count("*").alias("size"), F.bool_or(single).alias("any")).filter("size > 1 and any").drop("any")
        groups = materialise(groups, "hot-groups")
        left = spread_join(kinds.withColumn("alone", single).drop("times"), groups, "grp", groups)
        small.append(left.filter(F.col("size") <= HOT).select("grp", "id", "hash", "base", "anchor", "data", "alone"))
        # At the last pass a group's windows have all their bytes in common, so it has one kind.
        rows = materialise(_halves(left.filter((F.col("size") > HOT) & (F.col("low") < F.col("high"))), width), "hot-halves")
    return spans, small


def repeated_spans(rows: DataFrame, docs: DataFrame, width: int, k: int) -> DataFrame:
    """``id``, ``hash``, ``start``, ``end`` of stretches of repeated windows; they may overlap. ``docs``: ``rows``, dealt by ``id`` and ``hash``."""
    small_batches(docs.sparkSession)
    counts = _grams(rows, width, k).groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1")
    counts = materialise(counts, "grams")
    met = materialise(spread_join(_ranges(rows, width, k), counts, "gram", counts, per_task=HOT), "ranges")

    def strings(some: DataFrame) -> DataFrame:
        data = F.substring(F.col("text").cast("binary"), (F.col("base") + 1).cast("int"), F.col("more") + width).alias("data")
        return docs.join(some, ["id", "hash"]).select(F.col("gram").alias("grp"), "id", "hash", "base", "anchor", data, F.lit(True).alias("alone"))

    hot = met.filter(F.col("size") > HOT)
    spans, small = ([], []) if hot.isEmpty() else _hot_groups(strings(hot), width, k)
    cold = functools.reduce(DataFrame.unionByName, small, strings(met.filter(F.col("size") <= HOT)))
    return functools.reduce(DataFrame.unionByName, spans, _sorted_groups(cold, width))


def _covered(data: bytes, spans) -> np.ndarray:
    steps = np.zeros(len(data) + 1, "i8")
    np.add.at(steps, np.array([s["start"] for s in spans], "i8"), 1)
    np.add.at(steps, np.array([s["end"] for s in spans], "i8"), -1)
    return np.cumsum(steps)[:-1] > 0


def kept(text: Column, spans: Column) -> Column:
    """``struct<n_bytes, n_removed, n_spans, kept>``: ``text`` without the bytes of ``spans`` (null: none), an array of ``struct<start, end>``."""

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(texts, all_spans, strict=True):
            data = t.encode()
            if found is None or not len(found):
                out.append((len(data), 0, 0, data))
                continue
            gone = _covered(data, found)
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((len(data), int(gone.sum()), runs, np.frombuffer(data, "u1")[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return cut(text, spans)


def remove_repeats(df: DataFrame, width: int = 200, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay, for every row.

    A byte goes if a string of ``width`` bytes over it also starts anywhere else, in the same row
    or another; all strings are judged on the input. Rows of fewer bytes stay whole. Null text
    counts as empty. Repeated rows are copies of each other, so all their bytes go if they have
    ``width`` of them. A cut may fall inside a character, so ``kept`` is binary. Extra columns
    are not read.
    """
    rows = _rows(df, key, text)
    docs = rows.repartition("id", "hash")
    spans = repeated_spans(rows, docs, width, k)
    by_row = spans.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = docs.join(by_row, ["id", "hash"], "left").select(F.when(F.col("hash") % 2 == 0, F.col("id")).alias("doc_id"), kept(F.col("text"), F.col("spans")).alias("cut"))
    return cut.select("doc_id", "cut.*")


def cut_texts(df: DataFrame, width: int = 200, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with its texts cut as by ``remove_repeats``, and ``n_chars``, if there, counted anew.

    Of a passage that repeats everywhere nothing stays, as all its places are judged alike. Bytes
    of a character that was cut in two go too. Rows of which a repeat takes everything leave;
    other rows, empty ones too, stay.
    """
    rows = _rows(df, key, text)
    spans = repeated_spans(rows, rows.repartition("id", "hash"), width, k)
    by_row = spans.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    by_row = materialise(by_row, "repeated-spans")
    named = df.withColumn("__id", F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0))).withColumn("__hash", _name(F.col(f"`{key}`"), F.col(f"`{text}`")))
    found = named.join(by_row.withColumnsRenamed({"id": "__id", "hash": "__hash"}), ["__id", "__hash"], "left")

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, all_spans, strict=True):
            if t is None:
                out.append(None)
                continue
            gone = _covered(t.encode(), spans)
            out.append(np.frombuffer(t.encode(), "u1")[~gone].tobytes().decode("utf-8", "ignore"))
        return pd.Series(out, dtype="object")

    cut = F.when(F.col("__spans").isNull(), F.col(f"`{text}`")).otherwise(shorten(F.col(f"`{text}`"), F.coalesce("__spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))))
    found = found.withColumn(text, cut).filter(F.col("__spans").isNull() | (F.col(f"`{text}`") != ""))
    if "n_chars" in df.columns:
        found = found.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.char_length(F.col(f"`{text}`"))).cast(df.schema["n_chars"].dataType))
    return found.select(*df.columns)
