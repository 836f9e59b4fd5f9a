"""Toxic spans and scores by a linear-chain conditional random field.

Each token is toxic or not, by features of its word (the word, its prefixes and suffixes, the words
beside it) and of the step from the token before. Labels are of documents: of a bounded sample, the
tokens whose features lean most to toxic documents are labelled, all those of other documents are
clean, and the weights are learnt from these by follow-the-regularised-leader. A logistic curve,
fitted on marginals of documents that the weights have not seen, turns a document's forward-backward
marginals into its score; tokens that are more likely toxic than not are its spans.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.token_ids import small_batches

#: Hashed features; lengths of prefixes and suffixes; labelled rows of each kind that the weights are trained on.
DIMENSIONS, PREFIXES, SUFFIXES = 2**20, (3, 4, 5, 6, 7, 8), (3, 4)
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
#: Words kept in a worker, of so many characters; tokens that are looked at together.
WORDS, WORD_CHARS, TOGETHER = 400_000, 64, 400_000
#: A token's label: least z-score of its best feature, and for the best one of a document without such; least log odds ratio of a feature that counts.
SURE, LIKELY, LEAN = 5.0, 1.5, 1.5
_words = re.compile(r"\w+").findall
_places = re.compile(r"\w+").finditer
OWN = 2 + len(PREFIXES) + len(SUFFIXES)


def own_features(word: str) -> list[int]:
    """Numbers of a word's features: all words' common one, the word, its prefixes, its suffixes; ``DIMENSIONS`` where there is none."""
    parts = ["b", "w" + word, *(f"p{word[:n]}" if len(word) >= n else "" for n in PREFIXES), *(f"s{word[-n:]}" if len(word) > n else "" for n in SUFFIXES)]
    return [zlib.crc32(p.encode("utf-8", "replace")) % DIMENSIONS if p else DIMENSIONS for p in parts]


def beside_features(word: str) -> tuple[int, int]:
    """Numbers of the features that a word gives the token after it and the one before it."""
    return tuple(zlib.crc32((side + word).encode("utf-8", "replace")) % DIMENSIONS for side in "<>")


def chain(odds: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state at each token of documents in a row, and those of the token before.

    ``odds``: of each token by itself; ``first``: where a document begins; ``steps``: weights of
    clean-toxic, toxic-clean and toxic-toxic, clean-clean being 1. The tokens are cut into rows of
    equal length that are worked on side by side; the product of a row's 2 by 2 steps carries over
    what the rows before it tell.
    """
    ct, tc, tt = steps
    n = len(odds)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    e, reset = np.ones(rows * width), np.ones(rows * width, bool)
    e[:n], reset[:n] = odds, first
    e, reset = np.ascontiguousarray(e.reshape(rows, width).T), np.ascontiguousarray(reset.reshape(rows, width).T)
    a, b, c, d = (np.where(reset, 1.0, s) for s in (1.0, ct, tc, tt))  # a step's weights, all alike where a document begins
    product = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, rows)).copy()
    for i in range(width):
        left, right = product[:, 0] * a[i] + product[:, 1] * c[i], (product[:, 0] * b[i] + product[:, 1] * d[i]) * e[i]
        most = np.maximum(left.max(axis=0), right.max(axis=0))
        product[:, 0], product[:, 1] = left / most, right / most
    before, after = np.ones(rows), np.ones(rows)
    for r in range(1, rows):
        p = product[:, :, r - 1]
        u = before[r - 1]
        before[r] = (p[0, 1] + u * p[1, 1]) / (p[0, 0] + u * p[1, 0])
    for r in range(rows - 2, -1, -1):
        p = product[:, :, r + 1]
        v = after[r + 1]
        after[r] = (p[1, 0] + v * p[1, 1]) / (p[0, 0] + v * p[0, 1])
    forward, backward, ahead = np.empty_like(e), np.empty_like(e), np.empty_like(e)
    x = before
    for i in range(width):
        ahead[i] = x
        x = e[i] * (b[i] + d[i] * x) / (a[i] + c[i] * x)
        forward[i] = x
    y = after
    for i in range(width - 1, -1, -1):
        backward[i] = y
        v = e[i] * y
        y = (c[i] + d[i] * v) / (a[i] + b[i] * v)
    return tuple(m.T.ravel()[:n] for m in (forward, backward, ahead))


def marginals(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    both = forward * backward
    return both / (1 + both)


def evidence(p: np.ndarray) -> np.ndarray:
    """What a document's marginals say of it: how much toxicity, how dense, and the three most likely tokens."""
    top = np.zeros(3)
    if len(p):
        most = np.sort(np.partition(p, len(p) - 3)[-3:] if len(p) > 3 else p)[::-1]
        top[: len(most)] = most
    much = float((p * p).sum())
    return np.array([np.log1p(much), np.log1p(1000 * much / (len(p) + 50)), *top])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Coefficients, the constant last, of a penalised logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Ftrl:
    """Follow-the-regularised-leader with an elastic-net penalty over numbered features."""

    def __init__(self, size: int, alpha: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.l1, self.l2 = alpha, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((1 + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * self.weights(at)
        self.n[at] = more


class Corpus:
    """Sampled documents as numbers of their words, with the features of each word."""

    def __init__(self, texts: list[str], toxic: list[int]):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w.lower(), len(number)) for w in _words(t)], "i4") for t in texts]
        self.toxic = np.array(toxic, bool)
        self.own = np.array([own_features(w) for w in number], "i4").reshape(-1, OWN)
        self.beside = np.array([beside_features(w) for w in number], "i4").reshape(-1, 2)

    def labelled(self) -> list[np.ndarray]:
        """The label of each token: features that stand in more toxic documents than chance explains make a word of such a document toxic."""
        seen = np.zeros((2, DIMENSIONS + 1))
        kinds = [np.unique(d) for d in self.docs]
        lexical = self.own[:, 1 : 2 + len(PREFIXES)]
        for words, y in zip(kinds, self.toxic, strict=True):
            seen[int(y), np.unique(lexical[words])] += 1
        clean, toxic = seen
        n_clean, n_toxic = (~self.toxic).sum(), self.toxic.sum()
        lean = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (n_clean - clean + 0.5))
        z = np.where(lean >= LEAN, lean / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), 0.0)
        z[DIMENSIONS] = 0.0
        best = z[lexical].max(axis=1) if len(lexical) else np.zeros(0)
        out = []
        for d, words, y in zip(self.docs, kinds, self.toxic, strict=True):
            if y and len(d):
                most = best[words].max()
                out.append(best[d] >= (SURE if most >= SURE else max(most, LIKELY)))
            else:
                out.append(np.zeros(len(d), bool))
        return out


@dataclass
class Weights:
    features: np.ndarray
    steps: np.ndarray
    prior: float

    def of(self, own: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.features[own].sum(axis=1) + self.prior, self.features[beside[:, 0]], self.features[beside[:, 1]]


def token_odds(words: np.ndarray, first: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Odds of each token from its word and those beside it in its document."""
    score = own[words]
    inner = ~first[1:]
    score[1:] += before[words[:-1]] * inner
    score[:-1] += after[words[1:]] * inner
    return np.exp(np.clip(score, -30, 30))


def starts(sizes: list[int]) -> np.ndarray:
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])[: len(sizes)]] = True
    return first


def train(corpus: Corpus, labels: list[np.ndarray], rows: np.ndarray, alpha: float = 0.3, l1: float = 0.3, l2: float = 0.05, size: int = 100, least_steps: int = 100) -> Weights:
    """Weights from the labelled tokens of ``rows``, in batches of ``size`` documents."""
    rows = np.array([r for r in rows if len(corpus.docs[r])], int)
    n_toxic, n = sum(int(labels[r].sum()) for r in rows), sum(len(corpus.docs[r]) for r in rows)
    prior = float(np.log((n_toxic + 0.5) / (n - n_toxic + 0.5)))
    model, steps = Ftrl(DIMENSIONS + 1, alpha, l1, l2), Ftrl(3, alpha, 0.0, 0.05)
    batches = []
    for part in (rows[i::k] for k in [max(1, -(-len(rows) // size))] for i in range(k)):
        words, local = np.unique(np.concatenate([corpus.docs[r] for r in part]), return_inverse=True) if len(part) else (np.zeros(0, int), np.zeros(0, int))
        if len(words):
            used, at = np.unique(np.concatenate([corpus.own[words].ravel(), corpus.beside[words].ravel()]), return_inverse=True)
            cut = len(words) * OWN
            batches.append((used, at[:cut].reshape(-1, OWN), at[cut:].reshape(-1, 2), local, starts([len(corpus.docs[r]) for r in part]), np.concatenate([labels[r] for r in part])))
    for _ in range(max(5, -(-least_steps // max(1, len(batches))))):
        for used, own, beside, words, first, y in batches:
            w = model.weights(used)
            w[used == DIMENSIONS] = 0.0
            ct, tc, tt = weight = np.exp(steps.weights())
            odds = token_odds(words, first, w[own].sum(axis=1) + prior, w[beside[:, 0]], w[beside[:, 1]])
            forward, backward, ahead = chain(odds, first, weight)
            error = marginals(forward, backward) - y
            inner = ~first[1:]
            g = np.zeros(len(used))
            by_word = lambda at, e: np.bincount(at, e, minlength=len(own))
            g += np.bincount(own.ravel(), np.repeat(by_word(words, error), OWN), minlength=len(used))
            g += np.bincount(beside[:, 0], by_word(words[:-1], error[1:] * inner), minlength=len(used))
            g += np.bincount(beside[:, 1], by_word(words[1:], error[:-1] * inner), minlength=len(used))
            model.learn(used, g)
            u, v = ahead[1:][inner], (odds * backward)[1:][inner]
            total = 1 + ct * v + tc * u + tt * u * v
            y0, y1 = y[:-1][inner], y[1:][inner]
            steps.learn(np.arange(3), np.array([(ct * v / total - (~y0 & y1)).sum(), (tc * u / total - (y0 & ~y1)).sum(), (tt * u * v / total - (y0 & y1)).sum()]))
    features = model.weights()
    features[DIMENSIONS] = 0.0
    return Weights(features, np.exp(steps.weights()), prior)


def all_evidence(corpus: Corpus, rows: np.ndarray, weights: Weights) -> np.ndarray:
    out = np.zeros((len(rows), 5))
    own, before, after = weights.of(corpus.own, corpus.beside)
    for i, r in enumerate(rows):
        if len(words := corpus.docs[r]):
            first = starts([len(words)])
            forward, backward, _ = chain(token_odds(words, first, own, before, after), first, weights.steps)
            out[i] = evidence(marginals(forward, backward))
    return out


@dataclass
class Model:
    features: np.ndarray
    at: np.ndarray
    steps: np.ndarray
    prior: float
    curve: np.ndarray

    @property
    def weights(self) -> Weights:
        whole = np.zeros(DIMENSIONS + 1)
        whole[self.at] = self.features
        return Weights(whole, self.steps, self.prior)


def learn_sample(texts: list[str], toxic: list[int], shares: tuple[float, float]) -> Model:
    """A model of the sample's texts; ``shares``: how many documents each clean and each toxic one stands for.

    Equal texts count once. Two halves give each other's documents marginals that the weights were
    not fitted to, which the curve is fitted on; the weights kept are those of all.
    """
    once = list(dict.fromkeys(zip(texts, toxic, strict=True)))
    corpus = Corpus([t for t, _ in once], [y for _, y in once])
    labels, rows = corpus.labelled(), np.arange(len(once))
    order = np.argsort(corpus.toxic, kind="stable")  # both halves get their part of either kind
    seen = np.zeros((len(once), 5))
    for i in (0, 1):
        half, other = np.sort(order[i::2]), np.sort(order[1 - i :: 2])
        seen[half] = all_evidence(corpus, half, train(corpus, labels, other))
    fitted = curve(seen, corpus.toxic.astype(float), np.where(corpus.toxic, shares[1], shares[0]))
    w = train(corpus, labels, rows)
    at = np.flatnonzero(w.features)
    return Model(w.features[at], at, w.steps, w.prior, fitted)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | None:
    """A model from documents labelled by ``key``; None if they are not of both kinds.

    At most ``toxic_rows`` and ``clean_rows`` labelled rows are drawn, by a hash of their key: the
    stated bound. A key that is labelled twice is toxic if one label says so; null labels and keys
    don't count. The drawn keys are broadcast, so that no text is shuffled but the drawn ones.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{toxic}`").alias("toxic")).filter("key is not null and toxic is not null")
    known = known.groupBy("key").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return None
    drawn = known.withColumn("draw", F.xxhash64("key"))
    kinds = [drawn.filter(F.col("toxic") == y).orderBy("draw", "key").limit(n) for y, n in ((0, clean_rows), (1, toxic_rows))]
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sample = rows.join(F.broadcast(kinds[0].union(kinds[1])), "key").select("text", "toxic", "draw")  # at most both bounds

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, kind = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            kind += batch.column(1).to_pylist()
        if len(set(kind)) < 2:
            return
        shares = tuple(total[y] / min(total[y], n) for y, n in ((0, clean_rows), (1, toxic_rows)))
        model = learn_sample(texts, kind, shares)
        out = io.BytesIO()
        np.savez_compressed(out, features=model.features, at=model.at, steps=model.steps, prior=model.prior, curve=model.curve)
        yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})

    blob = sample.repartition(1).sortWithinPartitions("draw", "text").select("text", "toxic").mapInArrow(learn, "model binary").first()
    if blob is None:
        return None
    saved = np.load(io.BytesIO(blob[0]))
    return Model(saved["features"], saved["at"], saved["steps"], float(saved["prior"]), saved["curve"])


class Scorer:
    """Scores texts with one model; keeps the scores of the words it meets."""

    def __init__(self, model: Model):
        self.weights, self.curve = model.weights, model.curve
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.fresh: list[str] = []  # words that have a number but no scores yet
        self.scores = np.zeros((3, 0))

    def words(self, text: str) -> np.ndarray:
        number, fresh, known, out = self.number, self.fresh, self.scores.shape[1], []
        for w in _words(text):
            at = number.get(w)
            if at is None:
                at = known + len(fresh)
                fresh.append(w.lower())
                if len(w) <= WORD_CHARS:
                    number[w] = at
            out.append(at)
        return np.array(out, "i8")

    def score_fresh(self) -> None:
        if self.fresh:
            more = self.weights.of(np.array(list(map(own_features, self.fresh))), np.array(list(map(beside_features, self.fresh))))
            self.scores = np.concatenate([self.scores, more], axis=1)
            self.fresh = []

    def __call__(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """Score and spans of each text; spans are code points, ``end`` not included."""
        out, part, size = [], [], 0
        if self.scores.shape[1] > WORDS:
            self.forget()
        for text in texts:
            part.append((text, self.words(text)))
            size += len(part[-1][1])
            if size >= TOGETHER:
                out += self.together(part)
                part, size = [], 0
        return out + (self.together(part) if part else [])

    def together(self, part: list[tuple[str, np.ndarray]]) -> list[tuple[float, list[tuple[int, int]]]]:
        sizes = [len(w) for _, w in part]
        p = np.zeros(0)
        if sum(sizes):
            words, first = np.concatenate([w for _, w in part]), starts([n for n in sizes if n])
            self.score_fresh()
            own, before, after = self.scores
            forward, backward, _ = chain(token_odds(words, first, own, before, after), first, self.weights.steps)
            p = marginals(forward, backward)
        each = np.split(p, np.cumsum(sizes)[:-1])
        seen = np.array([evidence(x) for x in each])
        scores = logistic(np.column_stack([seen, np.ones(len(seen))]) @ self.curve)
        return [(float(s), spans(text, x)) for s, (text, _), x in zip(scores, part, each, strict=True)]


def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Runs of tokens that are more likely toxic than not."""
    toxic = np.flatnonzero(p >= 0.5)
    out: list[tuple[int, int]] = []
    if len(toxic):
        last, found, at = -2, _places(text), 0
        for i in toxic.tolist():
            m = next(islice(found, i - at, None))
            at = i + 1
            if i == last + 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            last = i
    return out


def score(text: Column, model: Model | None) -> Column:
    """``struct<score, spans>`` of each text; null counts as empty; without a model every score is 0."""
    schema = "score double, spans array<struct<start: int, end: int>>"
    if model is None:
        return F.struct(F.lit(0.0).alias("score"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    @F.pandas_udf(schema)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            found = scorer([t or "" for t in texts])
            yield pd.DataFrame({"score": [s for s, _ in found], "spans": [[{"start": a, "end": b} for a, b in x] for _, x in found]})

    return scored(text)
