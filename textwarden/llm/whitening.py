"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

A component's place in the spectrum is found without forming a covariance matrix: each step is one
pass over the vectors, a job that sums the centred product XᵀX·Q of a narrow block Q. Between two
Rayleigh-Ritz steps the passes follow the Chebyshev recurrence, which damps the unwanted spectrum.
One more column of the first passes carries a Lanczos run, whose least value bounds that spectrum
from below. Iteration ends when the residuals of the wanted pairs certify them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.runtime import materialise

#: Columns of the block beyond the wanted ones, passes of a filter, filters at most, vectors in a stored block.
EXTRA, DEGREE, ROUNDS, BLOCK_ROWS = 12, 8, 60, 4096
#: Residuals, as parts of the largest eigenvalue, that count as certified: once the first is met a step must at least halve it to go on, the last ends at once.
CERTIFIED, EXACT = 1e-11, 1e-15
#: Eigenvalues below this part of the trace are zero: such directions can't be scaled to unit variance.
LEAST = 1e-13


def scaled(vector: Column, scale: int) -> Column:
    """Each entry as ``floor(scale * entry)``."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, no null and no non-finite entry."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(F.transform(vector, lambda c: c.cast("double")), bad)


def packed(distinct: DataFrame, dimension: int) -> DataFrame:
    """``width`` and ``block``: at most ``BLOCK_ROWS`` vectors of ``x`` as integers of so many bytes, and ``sums`` of each dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            for at in range(0, len(whole), BLOCK_ROWS):
                part = whole[at : at + BLOCK_ROWS]
                largest = max(abs(int(part.min())), abs(int(part.max())))
                width = next(w for w in (1, 2, 4, 8) if largest < 2 ** (8 * w - 1) or w == 8)
                exact = part.astype(object) if largest >= 2**63 // BLOCK_ROWS else part
                yield pa.RecordBatch.from_pydict({
                    "width": pa.array([width], pa.int32()), "block": pa.array([part.astype(f"<i{width}").tobytes()], pa.binary()), "n": pa.array([len(part)], pa.int64()),
                    "sums": pa.array([[str(s) for s in exact.sum(axis=0)]], pa.list_(pa.string())),
                })

    return distinct.select("x").mapInArrow(pack, "width int, block binary, n bigint, sums array<string>")


@dataclass
class Components:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


class Covariance:
    """Products of the covariance matrix with narrow blocks, one pass over the stored vectors each."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.dimension, self.passes = blocks.select("width", "block"), n, len(sums), 0
        self.mean = np.array([s / n for s in sums])  # of integers, each division is rounded once

    def _sum(self, cells: int, part) -> np.ndarray:
        """The sums over all blocks of ``part`` of centred vectors; a task sends ``cells`` numbers, the driver gets as many."""
        mean, dimension = self.mean, self.dimension

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells)
            for batch in batches:
                for width, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = np.frombuffer(block.as_buffer(), f"<i{width}").reshape(-1, dimension)
                    total += part(x - mean).ravel()
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(cells, dtype="i4")), "value": pa.array(total)})

        self.passes += 1
        out = np.zeros(cells)
        for r in self.blocks.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            out[r["cell"]] = r["value"]
        return out / self.n

    def trace(self) -> float:
        return float(self._sum(self.dimension, lambda x: (x * x).sum(axis=0)).sum())

    def times(self, q: np.ndarray) -> np.ndarray:
        return self._sum(q.size, lambda x: x.T @ (x @ q)).reshape(q.shape)

    def projected(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the vectors' projections on ``w``."""
        k = w.shape[1]
        return self._sum(k * k, lambda x: (y := x @ w).T @ y).reshape(k, k)


class Lanczos:
    """A run of a single vector; its least Ritz value, less the last residual, estimates the least eigenvalue."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    def step(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(v @ product)
        rest = product - self.alpha[-1] * v
        for u in [*self.basis, *self.basis]:
            rest = rest - (u @ rest) * u
        self.beta.append(np.linalg.norm(rest))
        self.basis.append(rest / self.beta[-1] if self.beta[-1] > 0 else np.zeros_like(rest))

    @property
    def ended(self) -> bool:
        return bool(self.beta) and self.beta[-1] <= 1e-12 * max(self.alpha)

    def least(self) -> float:
        off = self.beta[:-1]
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + np.diag(off, 1) + np.diag(off, -1))
        return max(0.0, float(values[0] - self.beta[-1] * abs(vectors[-1, 0])))


def leading(v: Covariance, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and their unit vectors."""
    d = v.dimension
    width = min(d, wanted + EXTRA)
    rnd = np.random.default_rng(seed)
    q = np.linalg.qr(rnd.standard_normal((d, width)))[0]
    lanczos = Lanczos(rnd.standard_normal(d))
    product = v.times(np.column_stack([q, lanczos.basis[-1]]))
    lanczos.step(product[:, -1])
    image, low, before = product[:, :-1], 0.0, np.inf
    for _ in range(ROUNDS):
        # Rayleigh-Ritz: ``image`` is the product with the orthonormal ``q``.
        values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residual = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / max(values[0], np.finfo(float).tiny)
        if residual <= EXACT or (residual <= CERTIFIED and residual > before / 2) or width == d:
            break
        if residual > before / 2:
            low = 0.0  # slow: the estimate from below may be too high, zero never is
        before, high = residual, values[-1]
        # Chebyshev polynomials of the unwanted [low, high], scaled by their value at the largest eigenvalue.
        middle, half = (high + low) / 2, max((high - low) / 2, np.finfo(float).tiny)
        sigma = half / (values[0] - middle) if values[0] > middle else 1.0
        first, tau = sigma, 2 / sigma
        old, new = q, (image - middle * q) * (sigma / half)
        for _ in range(DEGREE - 1):
            riding = not lanczos.ended and len(lanczos.alpha) < min(d, DEGREE * 2)
            block = np.column_stack([new, lanczos.basis[-1]]) if riding else new
            product = v.times(block)
            if riding:
                lanczos.step(product[:, -1])
                product = product[:, :-1]
            nxt = 1 / (tau - sigma)
            old, new = new, (product - middle * new) * (2 * nxt / half) - old * (sigma * nxt)
            sigma = nxt
        low = lanczos.least() if first < 1 and lanczos.least() < high else 0.0
        q = np.linalg.qr(new)[0]
        image = v.times(q)
    return values[:wanted], q[:, :wanted]


def usable_rows(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``key`` and the scaled vector ``x`` of usable rows of the most frequent dimension (of several, the largest)."""
    found = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector")).filter(usable(F.col("vector")))
    sizes = found.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 0
    return found.filter(F.size("vector") == dimension).select("key", scaled(F.col("vector"), scale).alias("x"))


def fit(vectors: DataFrame, components: int = 4) -> Components | None:
    """The leading components of the distinct vectors ``x``, all of one dimension, which count once however often they stand there; None without a vector or a variance."""
    first = vectors.select(F.size("x")).first()
    if first is None or not first[0]:
        return None
    dimension = first[0]
    blocks = materialise(packed(vectors.select("x").distinct(), dimension), "vector-blocks")
    n = blocks.agg(F.sum("n")).first()[0]
    sums = [0] * dimension
    for r in blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["at"]] = int(r["s"])
    v = Covariance(blocks, n, sums)
    trace = v.trace()
    if not trace > 0:
        return None
    values, q = leading(v, min(components, dimension))
    kept = values > LEAST * trace
    values, q = values[kept], q[:, kept]
    spread = v.projected(q / np.sqrt(values))
    return Components(n, sums, values, q, values / trace, float(np.abs(spread - np.eye(len(values))).max()), v.passes)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``key``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped, as are those of
    another dimension than most. Repeated rows and equal vectors each get their rows but count once
    in the fit; null keys stay null. Components without variance are left out, so that a table with
    fewer than two distinct vectors, or none, gives no row. A deviation beyond a long is null.
    """
    found = usable_rows(rows, key, vector, scale)
    model = fit(found, components)
    out = "key {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double".format(dict(rows.dtypes)[key])
    if model is None:
        return rows.sparkSession.createDataFrame([], out).withColumnRenamed("key", key)
    n, sums, mean = model.n, model.sums, np.array([s / model.n for s in model.sums])
    axes = model.vectors / np.sqrt(model.values)  # dimension by component

    @F.pandas_udf("deviation bigint, whitened array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        total, largest_sum = np.array(sums, object), max(map(abs, sums))
        for xs in batches:
            if not len(xs):
                yield pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "whitened": []})
                continue
            x = np.stack(xs.to_numpy())
            reach = n * max(abs(int(x.min())), abs(int(x.max()))) + largest_sum
            if len(sums) * reach**2 < 2**63:
                deviation = (((n * x - total.astype("i8")) ** 2).sum(axis=1)).tolist()
            else:
                exact = ((n * x.astype(object) - total) ** 2).sum(axis=1)
                deviation = [int(s) if s < 2**63 else None for s in exact]
            yield pd.DataFrame({"deviation": pd.array(deviation, "Int64"), "whitened": list((x - mean) @ axes)})

    placed = found.select("key", project("x").alias("p")).select("key", "p.deviation", F.posexplode("p.whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(e)) for e in model.explained))
    return placed.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
