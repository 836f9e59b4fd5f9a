"""What segmentation keeps in memory: a trie of few bytes, and the words of some texts at a time."""

import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from textwarden.operators import segment, trie
from textwarden.operators.trie import Texts, Trie


def words_of(n, seed=1):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice("abcdefé研") for _ in range(rnd.randint(2, 9))) for _ in range(n)})


def texts_of(n, size, seed=2):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefé研🙂") for _ in range(size)) for _ in range(n)]


def test_bytes_of_a_trie():
    words = words_of(40_000)
    nodes = len({w[:i] for w in words for i in range(1, len(w) + 1)})
    held = sum(v.nbytes for v in vars(Trie.of(words, [1.0] * len(words))).values() if isinstance(v, np.ndarray))
    assert held < 13 * nodes


def test_parts_of_a_trie_and_a_mapped_one(monkeypatch):
    words = words_of(3000)
    whole = Trie.of(words, list(range(len(words))))
    parts = Trie.of_sorted((words[i : i + 70], np.arange(i, min(i + 70, len(words)), dtype="f8")) for i in range(0, len(words), 70))
    monkeypatch.setattr(trie, "MAPPED", 0)
    mapped = pickle.loads(pickle.dumps(whole))
    assert isinstance(mapped.codes.base, np.memmap)
    for other in (parts, mapped):
        assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(whole.parts(), other.parts(), strict=True))
    codes = Texts(texts_of(3, 300)).codes
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(whole.matches(codes, 9), mapped.matches(codes, 9), strict=True))


def test_words_leave_before_the_next_texts_are_looked_at(monkeypatch):
    words = segment.Words({w: float(i % 7) for i, w in enumerate(words_of(4000))})
    monkeypatch.setattr(segment, "TOGETHER", 20_000)
    texts = texts_of(600, 1000)
    texts[5] = texts[599] = None
    texts[7] = ""
    splits = [(segment.cut_bidirectional, 5), (segment.cut_cheapest, 5), (lambda w, n: segment.cut_graph(w, n, "search"), 9)]
    words.trie  # noqa: B018
    batch, seen, sizes = pa.array(texts), 0, []
    tracemalloc.start()
    for part in segment.segment_batches(iter([batch]), words, splits, 9):
        seen += len(part)
        sizes.append(len(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(texts) and max(sizes) <= 25 and peak < 25_000_000
    found = pa.concat_arrays(list(segment.segment_batches(iter([batch]), words, splits, 9)))
    for i in (0, 5, 6, 7, 8, 300, 599):
        t = texts[i]
        want = [segment.bidirectional(t, words, 5), segment.cheapest(t, words, 5, segment.OOV), segment.graph(t, words, 9, "search")] if t else [[], [], []]
        assert [found.field(k)[i].as_py() for k in range(3)] == want


def test_long_text_with_its_own_words(spark):
    """A dictionary that is no trie: substrings are listed piece by piece, words across the pieces' ends are found."""
    text = "".join(texts_of(1, 3 * segment.PIECE + 5)).replace("🙂", "x")
    table = spark.createDataFrame([(w, 1.0) for w in words_of(3000)] + [("ab", 5.0), ("ab", 5.0)], "word string, cost double")
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "ab")], "doc_id long, text string")
    one, other = ({r.doc_id: r.tokens for r in segment.segment_fmm(docs, table, 9, max_words=most).collect()} for most in (0, 10_000))
    assert one == other and one[4] == ["ab"] and one[2] == one[3] == []
