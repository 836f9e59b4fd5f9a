"""The random field against all labellings of short chains, and the operator on a made-up corpus with nulls, empties, repeats, clashing columns, long texts and no rows."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import queries, toxicity

SCHEMA = "doc_id long, text string, toxic string, score string, draw int, key string, spans int"
LABELS = "doc_id long, quality int, toxic int, draw string"
SF = "/root/testdata/sf0.01"


def brute(odds, first, steps):
    """Probability of the toxic state at each token, by all labellings."""
    pair = {(0, 0): 1.0, (0, 1): steps[0], (1, 0): steps[1], (1, 1): steps[2]}
    total, toxic = 0.0, np.zeros(len(odds))
    for labels in itertools.product([0, 1], repeat=len(odds)):
        weight = 1.0
        for i, y in enumerate(labels):
            weight *= odds[i] if y else 1.0
            if not first[i]:
                weight *= pair[labels[i - 1], y]
        total += weight
        toxic += weight * np.array(labels)
    return toxic / total


@pytest.mark.parametrize("seed", range(6))
def test_marginals(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(1, 13))
    odds, first, steps = np.exp(rnd.normal(0, 2, n)), rnd.random(n) < 0.3, np.exp(rnd.normal(0, 1, 3))
    first[0] = True
    forward, backward, ahead = toxicity.chain(odds, first, steps)
    assert np.allclose(toxicity.marginals(forward, backward), brute(odds, first, steps))
    assert np.allclose(ahead[1:][~first[1:]], forward[:-1][~first[1:]])


def test_documents_side_by_side():
    """A document's marginals don't depend on what stands beside it."""
    rnd = np.random.default_rng(9)
    sizes = [1, 500, 3, 40, 1, 1200]
    odds, first, steps = np.exp(rnd.normal(-2, 3, sum(sizes))), toxicity.starts(sizes), np.array([0.2, 0.3, 4.0])
    whole = toxicity.marginals(*toxicity.chain(odds, first, steps)[:2])
    parts = [toxicity.marginals(*toxicity.chain(o, toxicity.starts([len(o)]), steps)[:2]) for o in np.split(odds, np.cumsum(sizes)[:-1])]
    assert np.allclose(whole, np.concatenate(parts))


def made_up(n=400, seed=3):
    """Documents of which a fifth hold several words with a bad stem; one such word alone is harmless."""
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("aeioubdglmnrst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    bad = ["zorkan", "zorkil", "zorkum", "zorkedo"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.choice([5, 30, 120]))]
        toxic = i % 5 == 0
        for _ in range(rnd.randint(3, 6) if toxic else int(rnd.random() < 0.05)):
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = made_up()
    awkward = [(None, "no key"), (1000, None), (1001, ""), (5, rows[5][1])]
    docs = spark.createDataFrame([(k, t, "t", "s", 1, "k", 2) for k, t in rows + awkward], SCHEMA).repartition(3)
    more = [(1000, 0, 0, "x"), (1001, 0, 0, "x"), (None, 1, 1, "x"), (7, 1, None, "x"), (5, 0, 0, "x"), (99_999, 1, 1, "x")]
    return toxicity.fit(docs, spark.createDataFrame(labels + more, LABELS))


def scored(spark, rows, model):
    docs = spark.createDataFrame([(k, t, "t", "s", 1, "k", 2) for k, t in rows], SCHEMA)
    return docs.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("found")).select("doc_id", "text", "found.*").collect()


def test_new_documents(spark, model):
    rows, labels = made_up(200, seed=8)
    toxic = {k: y for k, _, y, _ in labels}
    found = scored(spark, rows, model)
    right = sum((r.score >= 0.5) == bool(toxic[r.doc_id]) for r in found)
    assert right >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)
    marked = [r.text[a:b] for r in found for a, b in r.spans]
    assert marked and sum(all(w.startswith("zork") for w in m.split()) for m in marked) >= 0.95 * len(marked)


def test_awkward_texts(spark, model):
    long = "mild words only " * 40_000
    bad = "zorkan zorkil and zorkum"
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + bad * 3), (6, "🙂 ZORKAN zorkil, zorkum"), (7, "x" * 200_000), (None, bad), (8, bad), (8, bad)]
    found = scored(spark, rows, model)
    by = {r.doc_id: r for r in found}
    assert by[1].score == by[2].score == by[3].score < 0.5 and by[1].spans == []
    assert by[4].score < 0.5 and by[7].score < 0.5 and by[5].spans[0].start >= len(long)
    assert [by[6].text[a:b] for a, b in by[6].spans] and by[6].spans[0].start == 2
    assert len({r.score for r in found if r.text == bad}) == 1 and len(found) == len(rows)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "x")], [(1, 1, 1, "x")], [(1, 1, None, "x")], [(77, 1, 1, "x"), (78, 1, 0, "x")]])
def test_nothing_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "one", "t", "s", 1, "k", 2)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    assert model is None and scored(spark, [(1, "one")], model)[0].score == 0.0


def test_no_rows(spark, model):
    assert scored(spark, [], model) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents(spark):
    found = queries.op13_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found)
    clean, toxic = ([r.score for r in found if r.toxic == y] for y in (0, 1))
    assert sum(a < b for a in clean for b in toxic) >= 0.9 * len(clean) * len(toxic)
