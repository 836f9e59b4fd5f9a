"""The trie and the column search against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.operators import segment
from textwarden.operators.trie import Texts, Trie, least_costs

LETTERS = "abc研🙂"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=12), max_size=5), st.dictionaries(st.text(alphabet=LETTERS, min_size=1, max_size=6), st.floats(0, 9), max_size=12), st.integers(1, 7))
def test_matches(texts, words, reach):
    all_ = Texts(texts)
    trie = Trie.of(list(words), list(words.values()))
    found = {(int(i), n): float(c) for n, at, cost in Trie(*trie.parts()).matches(all_.codes, reach) for i, c in zip(at, cost, strict=True)}
    want = {(s + i, n): words[t[i : i + n]] for t, s in all_ for i in range(len(t)) for n in range(1, min(reach, len(t) - i) + 1) if t[i : i + n] in words}
    assert found == want


def test_many_words():
    rnd = random.Random(2)
    words = list({"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(60_000)})
    trie, known = Trie.of(words, list(range(len(words)))), {w: i for i, w in enumerate(words)}
    text = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    found = {(int(i), n): c for n, at, cost in trie.matches(Texts([text]).codes, 9) for i, c in zip(at, cost, strict=True)}
    assert found == {(i, n): known[text[i : i + n]] for i in range(3000) for n in range(1, min(9, 3000 - i) + 1) if text[i : i + n] in known}


@pytest.mark.parametrize("sign", [1, -1])
def test_columns_and_single_texts_agree(sign):
    rnd = np.random.default_rng(3)
    sizes = np.array([0, 1, 700, 3, 40, 0, 41, 40, 5])
    first = np.cumsum(sizes + 1) - sizes - 1
    costs = rnd.integers(0, 6, (int(sizes.sum()) + len(sizes), 4)).astype(float)  # many ties
    together, alone = least_costs(first, sizes, costs, sign, few=0), least_costs(first, sizes, costs, sign, few=100)
    assert (together == alone).all()
    for f, size in zip(first, sizes, strict=True):
        best = [0.0]
        for j in range(1, size + 1):
            place = f + j if sign > 0 else f + size - j
            options = [(best[j - n] + costs[place, n - 1], n) for n in range(1, min(4, j) + 1)]
            best.append(min(options)[0])
            assert together[place] == min(options)[1]


def test_large_dictionary_is_not_exploded(spark):
    """Beyond the rows that are broadcast as tables, a dictionary is still a trie: no substring leaves its text."""
    words = spark.range(600_000).selectExpr("concat('w', id) AS word", "1.0 AS cost")
    docs = spark.createDataFrame([(1, "w5w599999xw600000")], "doc_id long, text string")
    found = segment.segment_fmm(docs, words, 7)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().tokens == ["w5", "w599999", "w60000"]


def test_long_and_short_texts_together():
    words = segment.Words({"ab": 1.0, "abc": 2.5, "c": 1.0, "bc": 0.5, "a": 2.0})
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcx") for _ in range(n)) for n in (0, 5000, 1, 30, 30, 2, 60)]
    for many, one in ((segment.all_forward, segment.forward), (segment.all_backward, segment.backward), (segment.all_bidirectional, segment.bidirectional)):
        assert many(segment.Walk(texts, words, 3), 3) == [one(t, words, 3) for t in texts]
    assert segment.all_cheapest(segment.Walk(texts, words, 4), 3, 15.0) == [segment.cheapest(t, words, 3, 15.0) for t in texts]
    for mode in ("accurate", "search", "full"):
        assert segment.all_graph(segment.Walk(texts, words, 3), 3, mode) == [segment.graph(t, words, 3, mode) for t in texts]
    assert segment.graph("xabcx", words, 3, "full") == ["x", "a", "ab", "abc", "bc", "c", "x"]
