"""Language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams (1 to 3
characters of letters and single spaces, lower case). Document frequencies are counted over all
labelled training rows. The weights are trained by follow-the-regularised-leader with an
elastic-net penalty, one pass in a single task over a sample of at most ``sample_rows`` training
rows (a stated bound), the last fifth of which calibrates the temperature of the softmax.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.token_ids import small_batches

#: Hashed features, longest n-gram, rows that the weights are trained on.
DIMENSIONS, ORDER, SAMPLE_ROWS = 2**16, 3, 6000
UNDETERMINED = "und"
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _tables:
        _tables.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _tables[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and counts of a text, or None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    before = np.concatenate([[False], letter[:-1]])
    codes = np.concatenate([codes[letter | before], [32]]).astype("u8")
    if codes[0] != 32:
        codes = np.concatenate([np.array([32], "u8"), codes])
    grams, code = [], codes
    for n in range(1, ORDER + 1):
        if n > 1:
            code = code[:-1] * np.uint64(0x110000) + codes[n - 1 :]
        mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append((mixed >> np.uint64(64 - 16)).astype("i8"))
    found = np.bincount(np.concatenate(grams), minlength=DIMENSIONS)
    at = np.flatnonzero(found)
    return at, found[at]


def weigh(features: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = features
    value = (1 + np.log(n)) * idf[at]
    length = np.sqrt((value**2).sum())
    return at, value / length if length else value


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        features = counts(text)
        if features is None or not self.classes:
            return UNDETERMINED, 0.0
        at, value = weigh(features, self.idf)
        p = softmax((value @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())  # ties: the first in alphabetical order
        return self.classes[best], float(p[best])


class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic loss; the last row is the bias."""

    def __init__(self, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, DIMENSIONS), np.append(value, 1.0)
        w = self.weights(at)
        error = softmax(value @ w)
        error[label] -= 1
        g = value[:, None] * error[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What the logits are divided by for the least log loss, searched from 0.05 to 20."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> Model:
    """A model of the non-null values of ``lang``; without labelled rows it knows no language."""
    small_batches(train.sparkSession)
    rows = train.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, langs = np.zeros(DIMENSIONS + 1, "i8"), {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (features := counts(t)) is not None:
                    found[features[0]] += 1
                    langs[name] = langs.get(name, 0) + 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "name": pa.nulls(len(at), pa.string()), "n": pa.array(found[at])})
        yield pa.RecordBatch.from_pydict({"at": pa.nulls(len(langs), pa.int32()), "name": pa.array(list(langs), pa.string()), "n": pa.array(list(langs.values()), pa.int64())})

    # At most DIMENSIONS rows and one for each language, whatever the input.
    totals = rows.mapInArrow(frequencies, "at int, name string, n bigint").groupBy("at", "name").agg(F.sum("n").alias("n")).collect()
    classes = sorted(r["name"] for r in totals if r["name"] is not None)
    documents = sum(r["n"] for r in totals if r["name"] is not None)
    df = np.zeros(DIMENSIONS)
    for r in totals:
        if r["at"] is not None:
            df[r["at"]] = r["n"]
    idf = np.log((1 + documents) / (1 + df)) + 1
    if not classes:
        return Model([], idf, np.zeros((DIMENSIONS, 0), "f4"), np.zeros(0), 1.0)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl(len(classes), alpha, beta, l1, l2), []
        number = {c: i for i, c in enumerate(classes)}
        for batch in batches:
            for t, name, share in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (features := counts(t)) is None:
                    continue
                if share < 8:
                    model.learn(*weigh(features, idf), number[name])
                else:
                    held.append((weigh(features, idf), number[name]))
        w = model.weights()
        weights, bias = w[:-1].astype("f4"), w[-1]
        logits = np.array([v @ weights[at] + bias for (at, v), _ in held]).reshape(len(held), len(classes))
        out = io.BytesIO()
        np.savez_compressed(out, weights=weights, bias=bias, temperature=temperature(logits, np.array([y for _, y in held], int)))
        yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})

    draw = F.pmod(F.xxhash64("text"), F.lit(2**40))
    share = min(1.0, 1.2 * sample_rows / max(1, documents))
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < int(share * 2**40)).orderBy("draw", "lang").limit(sample_rows)
    blob = drawn.select("text", "lang", (F.col("draw") % 10).cast("int").alias("share")).coalesce(1).mapInArrow(learn, "model binary").first()[0]
    saved = np.load(io.BytesIO(blob))
    return Model(classes, idf, saved["weights"], saved["bias"], float(saved["temperature"]))


def predict(text: Column, model: Model) -> Column:
    """``struct<lang, score>`` for each text; ``und`` with score 0 for null and texts without a letter."""
    blob = (model.classes, model.idf.astype("f4"), model.weights, model.bias, model.temperature)  # its size is fixed by DIMENSIONS

    @F.pandas_udf("lang string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*blob)
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score"])

    return guess(text)
