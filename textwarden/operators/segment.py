"""Dictionary segmentation of text into words.

Dictionaries are tables of ``word`` and ``freq`` or ``cost``. One of up to ``TRIE_WORDS`` words is
sent to the Python workers as a trie in flat arrays, which all places of many texts walk together;
of a larger one each text gets the words that stand in it, found by a join of its substrings with
the dictionary. Both give the same words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.text import filter_tokens, normalize_for_segmentation
from textwarden.operators.trie import SLICE, Texts, Trie, least_costs
from textwarden.runtime import materialise, spread

MAX_LEN, OOV = 5, 15.0
#: Words up to which a dictionary is a trie in each worker (some 30 bytes a word), characters that are looked at together, and costs that are kept at once for them.
TRIE_WORDS, TOGETHER, COSTS = 5_000_000, 400_000, 5_000_000
#: Characters of a text whose substrings are listed together, where the dictionary is no trie.
PIECE = 4096


def build_unigrams(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``word``, ``freq`` and ``cost`` = ln(total) - ln(max(freq, 1)) of a table of tokens."""
    counts = tokens.groupBy(F.col(token).alias("word")).agg(F.count("*").alias("freq"))
    total = counts.agg(F.sum("freq").alias("total"))
    cost = F.log(F.col("total").cast("double")) - F.log(F.greatest("freq", F.lit(1)).cast("double"))
    return counts.join(F.broadcast(total)).select("word", "freq", cost.alias("cost"))


def most_frequent(unigrams: DataFrame, words: int) -> DataFrame:
    """The ``words`` most frequent, ties by word."""
    return unigrams.orderBy(F.desc("freq"), "word").limit(words)


def add_words(dictionary: DataFrame, words: list[str]) -> DataFrame:
    """With words added as frequent ones (cost 0.1); they replace entries of the same word."""
    added = dictionary.sparkSession.createDataFrame([(w,) for w in words], "word string")
    rows = dictionary.withColumn("no", F.lit(0)).unionByName(added.withColumn("no", F.lit(1)).withColumn("cost", F.lit(0.1)), allowMissingColumns=True)
    kept = [c for c in rows.columns if c not in ("word", "no")]
    found = rows.groupBy("word").agg(F.max_by(F.struct(*kept), "no").alias("v"))
    return found.select("word", *(F.col("v")[c].alias(c) for c in kept))


class Words(dict):
    """A dictionary's words with their costs; the dearest of them and the length of the longest word, which may be those of a larger dictionary."""

    def __init__(self, costs: dict[str, float], dearest: float | None = None, longest: int | None = None):
        super().__init__(costs)
        self.dearest = max(self.values(), default=0.0) if dearest is None else dearest
        self.longest = max(map(len, self), default=1) if longest is None else longest

    @cached_property
    def trie(self) -> Trie:
        return Trie.of(list(self), list(self.values()))


class Dictionary:
    """A trie with what ``Words`` knows, as it is sent to workers."""

    def __init__(self, trie: Trie, dearest: float, longest: int):
        self.trie, self.dearest, self.longest = trie, dearest, longest


class Walk(Texts):
    """Texts with all words that stand in them, found once for all segmenters that look at them."""

    def __init__(self, texts: list[str], words: Words | Dictionary, reach: int):
        super().__init__(texts)
        self.dearest = words.dearest
        self.met = list(words.trie.matches(self.codes, reach))

    def words(self, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return (m for m in self.met if m[0] <= reach)


class Cuts:
    """Words of each of a walk's texts: ``at`` and ``size``, the place and length of each word, by text, and ``counts`` of words of each text."""

    def __init__(self, at: np.ndarray, size: np.ndarray, counts: np.ndarray):
        self.at, self.size, self.counts = at, size, counts

    @classmethod
    def of(cls, walk: Walk, at: list[int] | np.ndarray) -> Cuts:
        """Words without gaps that begin at the places ``at``."""
        at = np.sort(np.asarray(at, "i8"))
        text = np.searchsorted(walk.first, at, "right") - 1
        ends = (walk.first + walk.sizes)[text]
        size = np.minimum(np.append(at[1:], len(walk.codes)), ends) - at
        return cls(at, size, np.bincount(text, minlength=len(walk.first)))

    def lists(self, walk: Walk) -> list[list[str]]:
        at, size, cut = self.at.tolist(), self.size.tolist(), np.append(0, np.cumsum(self.counts)).tolist()
        return [[t[at[i] - s : at[i] - s + size[i]] for i in range(a, b)] for (t, s), a, b in zip(walk, cut, cut[1:], strict=False)]

    def arrow(self, walk: Walk, rows: np.ndarray) -> pa.Array:
        """The words as lists of strings, a list for each row; ``rows`` has the row of each text, and other rows are empty."""
        before = np.cumsum(self.size) - self.size
        codes = walk.codes[np.repeat(self.at - before, self.size) + np.arange(int(self.size.sum()))]
        wide = np.append(0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)))
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        offsets = wide[np.append(before, len(codes))].astype("i4")
        words = pa.StringArray.from_buffers(len(self.at), pa.py_buffer(offsets), pa.py_buffer(text))
        counts = np.zeros(len(rows), "i8")
        counts[rows] = self.counts
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype("i4")), words)


def _onward(walk: Walk, size: np.ndarray) -> Cuts:
    """From the left, the word at each place as long as ``size`` has it."""
    ahead, at = size.tolist(), []
    for s, n in zip(walk.first.tolist(), walk.sizes.tolist(), strict=True):
        i, e = s, s + n
        while i < e:
            at.append(i)
            i += ahead[i]
    return Cuts.of(walk, at)


def _back(walk: Walk, size: np.ndarray) -> Cuts:
    """From the right, the word that ends at each place as long as ``size`` has it."""
    behind, at = size.tolist(), []
    for s, n in zip(walk.first.tolist(), walk.sizes.tolist(), strict=True):
        i = s + n
        while i > s:
            i -= behind[i]
            at.append(i)
    return Cuts.of(walk, at)


def cut_forward(walk: Walk, reach: int) -> Cuts:
    """By the longest word that begins at each place."""
    ahead = np.ones(len(walk.codes), "i4")
    for n, at, _ in walk.words(reach):
        ahead[at] = n
    return _onward(walk, ahead)


def cut_backward(walk: Walk, reach: int) -> Cuts:
    """By the longest word that ends at each place."""
    behind = np.ones(len(walk.codes), "i4")
    for n, at, _ in walk.words(reach):
        behind[at + n] = n
    return _back(walk, behind)


def cut_bidirectional(walk: Walk, reach: int) -> Cuts:
    """Of both directions the one with fewer words, then with fewer single characters, then the backward one."""
    ahead, behind = cut_forward(walk, reach), cut_backward(walk, reach)
    place = lambda c: np.repeat(np.arange(len(c.counts)), c.counts)
    alone = lambda c: np.bincount(place(c)[c.size == 1], minlength=len(c.counts))
    first = (ahead.counts < behind.counts) | ((ahead.counts == behind.counts) & (alone(ahead) < alone(behind)))
    return Cuts.of(walk, np.concatenate([ahead.at[first[place(ahead)]], behind.at[~first[place(behind)]]]))


def cut_cheapest(walk: Walk, reach: int, oov: float = OOV) -> Cuts:
    """The split of least cost; an unknown piece costs ``oov`` for each character. Ties keep the shorter last word."""
    costs = np.tile(oov * np.arange(1, reach + 1), (len(walk.codes), 1))
    for n, at, cost in walk.words(reach):
        costs[at + n, n - 1] = cost
    return _back(walk, least_costs(walk.first, walk.sizes, costs, 1))


def cut_graph(walk: Walk, reach: int, mode: str = "accurate") -> Cuts:
    """``accurate``: the most probable path over the dictionary's words, single characters, known or dearer than any word, where there is none; ``full``: every word found; ``search``: the accurate words, each after the shorter words in it."""
    met = list(walk.words(reach))
    if mode == "full":
        return _every_word(walk, met)
    found = _onward(walk, _probable(walk, met))
    return _with_parts(walk, found, met) if mode == "search" and len(found.at) else found


def _probable(walk: Walk, met: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """At each place the length of the word that the cheapest path goes on with, the shortest of equals; a character that is no word is dearer than any."""
    at = np.concatenate([np.zeros(0, "i8"), *(a for _, a, _ in met)])
    size = np.concatenate([np.zeros(0, "i8"), *(np.full(len(a), n) for n, a, _ in met)])
    order = np.lexsort((-size, at))[::-1]  # from the last place, and there from the shortest
    cost = np.concatenate([np.zeros(0), *(c for _, _, c in met)])[order].tolist()
    words = np.bincount(at, minlength=len(walk.codes))
    words[walk.first + walk.sizes] = -1  # a text's end
    size, rare, k = size[order].tolist(), walk.dearest + 1.0, 0
    best, pick = [0.0] * (len(walk.codes) + 1), [1] * len(walk.codes)
    for p, n in zip(range(len(words) - 1, -1, -1), words[::-1].tolist(), strict=True):
        if n < 0:
            continue
        least, of = best[p + 1] + rare, 1
        if n:
            end = k + n
            if size[k] == 1:
                least = best[p + 1] + cost[k]
                k += 1
            while k < end:
                total = best[p + size[k]] + cost[k]
                if total < least:
                    least, of = total, size[k]
                k += 1
        best[p], pick[p] = least, of
    return np.array(pick, "i4")


def _with_parts(walk: Walk, found: Cuts, met: list[tuple[int, np.ndarray, np.ndarray]]) -> Cuts:
    """Before each word the words of two, then of three characters that are in it and shorter."""
    word, size, at = [np.arange(len(found.at))], [found.size], [found.at]
    for n, places, _ in met:
        if n in (2, 3):
            of = np.searchsorted(found.at, places, "right") - 1
            inside = (found.size[of] > n) & (places + n <= found.at[of] + found.size[of])
            word.append(of[inside])
            size.append(np.full(int(inside.sum()), n))
            at.append(places[inside])
    last = np.concatenate([np.full(len(found.at), 4), *size[1:]])
    word, size, at = np.concatenate(word), np.concatenate(size), np.concatenate(at)
    order = np.lexsort((at, last, word))
    text = np.repeat(np.arange(len(found.counts)), found.counts)[word]
    return Cuts(at[order], size[order], np.bincount(text, minlength=len(found.counts)))


def _every_word(walk: Walk, met: list[tuple[int, np.ndarray, np.ndarray]]) -> Cuts:
    """Every word by its place and length, and the characters that no word covers."""
    edge = np.zeros(len(walk.codes) + 1, "i8")
    for n, at, _ in met:
        edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + n, minlength=len(edge))
    bare = np.cumsum(edge)[:-1] == 0
    bare[walk.first + walk.sizes] = False
    alone = np.flatnonzero(bare)
    at = np.concatenate([alone, *(a for _, a, _ in met)])
    n = np.concatenate([np.ones(len(alone), "i8"), *(np.full(len(a), k) for k, a, _ in met)])
    order = np.lexsort((n, at))
    at, n = at[order], n[order]
    return Cuts(at, n, np.diff(np.append(np.searchsorted(at, walk.first), len(at))))


def all_forward(walk: Walk, reach: int) -> list[list[str]]:
    return cut_forward(walk, reach).lists(walk)


def all_backward(walk: Walk, reach: int) -> list[list[str]]:
    return cut_backward(walk, reach).lists(walk)


def all_bidirectional(walk: Walk, reach: int) -> list[list[str]]:
    return cut_bidirectional(walk, reach).lists(walk)


def all_cheapest(walk: Walk, reach: int, oov: float = OOV) -> list[list[str]]:
    return cut_cheapest(walk, reach, oov).lists(walk)


def all_graph(walk: Walk, reach: int, mode: str = "accurate") -> list[list[str]]:
    return cut_graph(walk, reach, mode).lists(walk)


def forward(text: str, words: Words, max_len: int) -> list[str]:
    return all_forward(Walk([text], words, max_len), max_len)[0]


def backward(text: str, words: Words, max_len: int) -> list[str]:
    return all_backward(Walk([text], words, max_len), max_len)[0]


def bidirectional(text: str, words: Words, max_len: int) -> list[str]:
    return all_bidirectional(Walk([text], words, max_len), max_len)[0]


def cheapest(text: str, costs: Words, max_len: int, oov: float) -> list[str]:
    return all_cheapest(Walk([text], costs, max_len), max_len, oov)[0]


def graph(text: str, costs: Words, max_len: int, mode: str) -> list[str]:
    return all_graph(Walk([text], costs, max_len), max_len, mode)[0]


#: Words of each text, from a walk and the length of the longest word to be looked at.
Split = Callable[[Walk, int], Cuts]


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of so many characters each, so many texts at a time that they have some ``most`` characters."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _segmented(texts: list[str | None], words: Words | Dictionary, splits: list[tuple[Split, int]], reach: int) -> pa.StructArray:
    """The words of each text by each of ``splits``."""
    rows = np.array([bool(t) for t in texts])
    walk = Walk([t for t in texts if t], words, reach)
    found = [split(walk, n).arrow(walk, rows) for split, n in splits]
    return pa.StructArray.from_arrays(found, names=[f"w{i}" for i in range(len(found))])


def segment_batches(batches: Iterator[pa.Array], words: Words | Dictionary, splits: list[tuple[Split, int]], reach: int) -> Iterator[pa.StructArray]:
    """The words of all texts in order, in parts that don't grow with a batch: those of some ``TOGETHER`` characters leave before the next ones are looked at."""
    together = max(1, min(TOGETHER, COSTS // reach))
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch), 0).to_pylist()
        for a, b in _groups(sizes, together):
            yield _segmented(batch.slice(a, b - a).to_pylist(), words, splits, reach)


def segmented_ways(docs: DataFrame, dictionary: DataFrame, ways: dict[str, tuple[Split, int | None]], stopwords: list[str] = (), text: str = "text", max_words: int = TRIE_WORDS) -> DataFrame:
    """``docs`` with a column of words for each of ``ways``, a splitter and its longest word (None: the dictionary's), from one pass over ``text``. Null and empty texts have none. Of a word that the dictionary has twice the greater cost counts."""
    cost = F.coalesce(F.col("cost").cast("double"), F.lit(0.0)) if "cost" in dictionary.columns else F.lit(0.0)
    entries = dictionary.filter("word != ''").groupBy("word").agg(F.max(cost).alias("cost"))
    most, longest, number = entries.agg(F.max("cost"), F.max(F.char_length("word")), F.count("*")).first()
    longest, most = longest or 1, most or 0.0
    splits = [(split, longest if n is None else n) for split, n in ways.values()]
    reach = max(n for _, n in splits)
    docs = spread(docs).withColumn("__clean", normalize_for_segmentation(F.col(text)))
    schema = ", ".join(f"w{i} array<string>" for i in range(len(splits)))
    columns = {name: filter_tokens(F.col(f"__words.w{i}"), list(stopwords)) for i, name in enumerate(ways)}

    if number <= max_words:
        found = entries.orderBy("word").toArrow()
        parts = (found.slice(i, SLICE) for i in range(0, found.num_rows, SLICE))
        trie = Trie.of_sorted((p["word"].to_pylist(), p["cost"].to_numpy()) for p in parts)
        del found
        shared = dictionary.sparkSession.sparkContext.broadcast(Dictionary(trie, most, longest))

        @F.arrow_udf(schema)
        def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from segment_batches(batches, shared.value, splits, reach)

        return docs.withColumn("__words", segment("__clean")).withColumns(columns).drop("__clean", "__words")

    @F.arrow_udf("array<string>")
    def substrings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for t in batch:
                piece = t.as_py() or ""
                yield pa.array([list({piece[i : i + n] for i in range(min(PIECE, len(piece))) for n in range(1, reach + 1)})], pa.list_(pa.string()))

    @F.arrow_udf(schema)
    def segment_by_own(texts: pa.Array, words: pa.Array) -> pa.Array:
        own = (Words({w["word"]: w["cost"] for w in (found or ())}, most, longest) for found in (x.as_py() for x in words))
        return pa.concat_arrays([_segmented([t.as_py()], w, splits, reach) for t, w in zip(texts, own, strict=True)])

    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("__clean"), F.lit(1)), F.lit(PIECE)), lambda i: F.substring("__clean", i, F.lit(PIECE + reach - 1)))
    parts = rows.filter("__clean != ''").select("__row", F.explode(pieces).alias("piece")).select("__row", F.explode(substrings("piece")).alias("word"))
    own = parts.join(entries, "word").groupBy("__row").agg(F.collect_set(F.struct("word", "cost")).alias("__own"))  # no more than its text has substrings
    return rows.join(own, "__row", "left").withColumn("__words", segment_by_own("__clean", "__own")).withColumns(columns).drop("__row", "__clean", "__own", "__words")


def segmented(docs: DataFrame, dictionary: DataFrame, split: Split, max_len: int | None = MAX_LEN, stopwords: list[str] = (), text: str = "text", out: str = "tokens", max_words: int = TRIE_WORDS) -> DataFrame:
    """``docs`` with ``out``, the words of ``text`` as ``split`` finds them; ``max_len`` None takes the dictionary's longest word. Null and empty texts have none."""
    return segmented_ways(docs, dictionary, {out: (split, max_len)}, stopwords, text, max_words)


def segment_pages(pages: DataFrame, dictionary: DataFrame, stopwords: list[str] = (), max_len: int = MAX_LEN, mode: str = "accurate", oov: float = OOV, text: str = "clean_text", **options) -> DataFrame:
    """Pages with ``seg_jieba`` (word graph), ``seg_maxmatch`` (both directions) and ``seg_dp`` (least cost), from one walk of each text."""
    ways = {
        "seg_jieba": (lambda walk, n: cut_graph(walk, n, mode), None),
        "seg_maxmatch": (cut_bidirectional, max_len),
        "seg_dp": (lambda walk, n: cut_cheapest(walk, n, oov), max_len),
    }
    return segmented_ways(pages, dictionary, ways, stopwords, text, **options)


def segment_fmm(docs: DataFrame, dictionary: DataFrame, max_len: int = MAX_LEN, **options) -> DataFrame:
    """Longest words from the left. Options of all segmenters: see ``segmented``."""
    return segmented(docs, dictionary, cut_forward, max_len, **options)


def segment_bmm(docs: DataFrame, dictionary: DataFrame, max_len: int = MAX_LEN, **options) -> DataFrame:
    """Longest words from the right."""
    return segmented(docs, dictionary, cut_backward, max_len, **options)


def segment_bimm(docs: DataFrame, dictionary: DataFrame, max_len: int = MAX_LEN, **options) -> DataFrame:
    """The better of both directions."""
    return segmented(docs, dictionary, cut_bidirectional, max_len, **options)


def segment_dp(docs: DataFrame, dictionary: DataFrame, oov: float = OOV, max_len: int | None = MAX_LEN, **options) -> DataFrame:
    """The split of least cost."""
    return segmented(docs, dictionary, lambda walk, n: cut_cheapest(walk, n, oov), max_len, **options)


def segment_dag(docs: DataFrame, dictionary: DataFrame, mode: str = "accurate", **options) -> DataFrame:
    """The most probable path, with ``mode`` as in ``cut_graph``; any other mode is ``accurate``."""
    return segmented(docs, dictionary, lambda walk, n: cut_graph(walk, n, mode), None, **options)
