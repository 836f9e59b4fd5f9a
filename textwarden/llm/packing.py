"""Best-fit packing of token sequences under several capacities.

Longer documents are cut; the pieces are dealt at random into groups of a bounded size and each
group is packed by itself, largest piece first, into the open sequence that the measure prefers
among those with room for it in every dimension: tokens, documents, and attention cost (the sum
of squared lengths). Only the last sequences of a group can be half empty, so the loss against
packing all at once falls with the group size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textwarden.llm.token_ids import WORDS, crc32, encoder, small_batches, wide

GROUP_ROWS = 8192
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` for each piece of each row; null text counts as empty and is its end id alone. Workers keep as many ``words``."""
    small_batches(df.sparkSession)

    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(tokenizer, words)
        end = np.array([end_id], "<u2").tobytes()
        for texts in batches:
            out = []
            for coded in encode([t or "" for t in texts]):
                ids = wide(coded + end)
                out.append([{"piece": i, "start": at, "length": n, "ids_crc32": crc32(ids[at : at + n])} for i, (at, n) in enumerate(cuts(len(ids), capacity))])
            yield pd.Series(out)

    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.explode(cut(F.col(f"`{text}`"))).alias("p"))
    return rows.select("doc_id", "p.*")


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, measure: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. ``capacity``: tokens, documents, attention cost.

    ``norm`` takes the bin whose weighted residual, after the piece, is the shortest vector;
    ``dot`` the one whose residual has the largest weighted product with the piece's demand.
    Ties go to the bin opened first.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    left, names, opened = np.empty((3, 256)), np.empty(256, "i8"), 0
    n, made, least = 0, 0, lengths.min(initial=0)
    scale = weights / capacity**2
    for k, i in enumerate(order):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (need > capacity).any():
            raise ValueError(f"a piece of {lengths[i]} tokens fits in no sequence")
        if k % 512 == 511:  # sequences without room for even the smallest piece leave
            stay = np.flatnonzero((left[0, :n] >= least) & (left[1, :n] >= 1) & (left[2, :n] >= float(least) ** 2))
            left[:, : len(stay)], names[: len(stay)], n = left[:, stay], names[stay], len(stay)
        after = left[:, :n] - need[:, None]
        fits = (after >= 0).all(axis=0)
        if fits.any():
            score = (after**2 * scale[:, None]).sum(axis=0) if measure == "norm" else -(left[:, :n] * (need * scale)[:, None]).sum(axis=0)
            at = int(np.argmin(np.where(fits, score, np.inf)))
        else:
            if n == left.shape[1]:
                left, names = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([names, np.empty_like(names)])
            at, n = n, n + 1
            left[:, at], names[at] = capacity, made
            made += 1
        bins[i], offsets[i] = names[at], capacity[0] - left[0, at]
        left[:, at] -= need
    return bins, offsets


def pack(
    rows: DataFrame, capacity: int = 2048, max_documents: int | None = None, max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0), measure: str = "norm", group_rows: int = GROUP_ROWS, length: str = "length",
) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: the sequence of each piece and its first token's place there.

    Limits that are None don't bind. Every row gets a place, repeated rows each their own; a null
    or zero length takes no tokens; an empty table gives an empty result. Columns called
    ``sequence_id`` or ``offset`` are replaced.
    """
    total = rows.count()
    groups = max(1, math.ceil(total / group_rows))
    limits = np.array([capacity, max_documents or 2**31, max_attention or float(capacity) ** 2])
    weight = np.array(weights)
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    names = [f"c{i}" for i in range(len(kept))]  # so that no name of the input clashes with ours
    dealt = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("long").alias("n"))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("n", F.monotonically_increasing_id()), F.lit(groups)))

    def place(table):
        import pyarrow as pa

        bins, offsets = best_fit(table["n"].to_numpy(), limits, weight, measure)
        group = table["group"].to_numpy().astype("i8")
        return table.select(names).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    schema = StructType([StructField(n, rows.schema[c].dataType) for c, n in zip(kept, names, strict=True)]).add("sequence_id", LongType()).add("offset", LongType())
    placed = dealt.groupBy("group").applyInArrow(place, schema)
    return placed.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), "sequence_id", "offset")
