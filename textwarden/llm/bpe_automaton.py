"""BPE as a tokenization automaton.

The automaton reads tokens; its states are named by the token read last, and an arc from ``x``
labelled ``y`` says that ``y`` may follow ``x`` in the encoding of a word. It starts as the
automaton of all byte strings, with an arc between any two bytes, and each merge ``a b -> ab``,
in order of rank, changes it by a gadget: a state ``ab`` is added with the arcs that state ``b``
has at that moment; the arc ``b`` leaves state ``a``; and every state that has an arc ``a`` then
gets an arc ``ab``. (In this order also if ``a`` is ``b``, as runs merge from the left.)

``compiled`` applies the gadgets of all merges to a table of states by symbols, one bit for each
arc, and then merges states with the same arcs. Tokens that begin with a space can only be the
first of a word (or be of white space as a whole), so only the others are symbols of the table; the
start has an arc for every token. The table is built once and broadcast; its size is bounded by
the vocabulary's (some 30 MB for 50,000 tokens).

A word's encoding is the only path from the start whose labels spell it. It is found in one pass
over the bytes: every prefix of a word has its own encoding, of which the state after it is the
last token. Many words take their steps together. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.token_ids import PATTERN, WORD_CHARS, WORDS, byte_letters, cutter, wide

#: The bytes of white space.
_WHITE = {*range(9, 14), *" \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000".encode()}
#: Words that take their steps together, and bytes beyond which a word goes by itself.
TOGETHER, LONG_WORD = 4096, 192
_GOLDEN = 0x9E3779B97F4A7C15


def compiled(labels: dict[int, bytes], merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table (rows of bits), the row of each state and the column of each symbol (-1: none). ``merges``: left, right and merged token, by rank."""
    symbols = [t for t, s in labels.items() if not s.startswith(b" ") or _WHITE.issuperset(s)]
    column = np.full(max(labels) + 1, -1)
    column[symbols] = np.arange(len(symbols))
    start = [t for t, s in labels.items() if len(s) == 1]
    row = {t: i for i, t in enumerate(start)}
    table = np.zeros((len(start) + len(merges), -(-len(symbols) // 8)), "u1")
    for byte in start:
        table[: len(start), column[byte] >> 3] |= np.uint8(1 << (column[byte] & 7))
    for n, (a, b, ab) in enumerate(merges, len(start)):
        ca, cb, cab = column[a], column[b], column[ab]
        table[n], row[ab] = table[row[b]], n
        if cb >= 0:
            table[row[a], cb >> 3] &= np.uint8(255 - (1 << (cb & 7)))
        if cab >= 0:
            has_a = (table[: n + 1, ca >> 3] >> np.uint8(ca & 7)) & np.uint8(1)
            table[: n + 1, cab >> 3] |= has_a << np.uint8(cab & 7)
    kinds, kind_of = np.unique(table.view(f"V{table.shape[1]}").ravel(), return_inverse=True)
    rows = np.zeros(len(column), "i4")
    rows[list(row)] = kind_of[list(row.values())]
    return kinds.view("u1").reshape(len(kinds), -1), rows, column.astype("i4")


class Automaton:
    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.table, self.row, self.column = compiled(labels, merges)
        tokens = [t for t, s in labels.items() if len(s) == 1] + [m for _, _, m in merges]
        self._trie(labels, tokens)
        self.length = np.zeros(max([*labels, *special.values()]) + 1, "i4")
        for t, s in labels.items():
            self.length[t] = len(s)
        self.special = special
        self.labels = labels | {i: s.encode() for s, i in special.items()}

    def _trie(self, labels: dict[int, bytes], tokens: list[int]) -> None:
        """The labels from their ends, as a hash table from node and byte to node, and the token that ends at each node."""
        nodes: dict[int, int] = {}
        ends = {}
        for token in tokens:
            node = 0
            for byte in reversed(labels[token]):
                node = nodes.setdefault(node << 8 | byte, len(nodes) + 1)
            ends[node] = token
        self.token = np.full(len(nodes) + 1, -1, "i4")
        self.token[list(ends)] = list(ends.values())
        self.bits = (2 * len(nodes)).bit_length()
        self.keys, self.nodes = np.full(1 << self.bits, -1, "i8"), np.zeros(1 << self.bits, "i4")
        keys, values = np.array(list(nodes), "i8"), np.array(list(nodes.values()), "i4")
        spot = self._spot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[spot] < 0)
            _, first = np.unique(spot[free], return_index=True)
            placed = free[first]
            self.keys[spot[placed]], self.nodes[spot[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, spot = keys[rest], values[rest], (spot[rest] + 1) & (len(self.keys) - 1)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(_GOLDEN)) >> np.uint64(64 - self.bits)).astype("i8")

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node after ``byte``, or -1."""
        key = node.astype("i8") << 8 | byte
        spot = self._spot(key)
        found = self.keys[spot]
        while True:
            on = np.flatnonzero((found != key) & (found >= 0))
            if not len(on):
                return np.where(found == key, self.nodes[spot], -1)
            spot[on] = (spot[on] + 1) & (len(self.keys) - 1)
            found[on] = self.keys[spot[on]]

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token beside it."""
        column = self.column[tokens]
        bit = self.table[self.row[states], column >> 3] >> (column & 7).astype("u1") & np.uint8(1)
        return (bit == 1) & (column >= 0)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The encoding of each pre-split word (none is empty) as little-endian 16-bit ids."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), "i8", len(words))
        order = np.argsort(sizes, kind="stable")
        short = order[: np.searchsorted(sizes[order], LONG_WORD, "right")]
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            for i, ids in zip(part.tolist(), self._together([words[i] for i in part.tolist()], sizes[part]), strict=True):
                out[i] = ids
        for i in order[len(short) :].tolist():
            out[i] = self._alone(words[i])
        return out

    def _together(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        """``words`` by ascending size."""
        n, most = len(words), int(sizes[-1])
        data = np.frombuffer(b"".join(words), "u1")
        starts = np.cumsum(sizes) - sizes
        state = np.full((most + 1, n), -1, "i4")  # the last token of each prefix
        for end in range(1, most + 1):
            word = np.arange(np.searchsorted(sizes, end), n)
            node = np.zeros(len(word), "i4")
            for at in range(end - 1, -1, -1):
                node = self._step(node, data[starts[word] + at])
                token = self.token[node]
                met = np.flatnonzero((node >= 0) & (token >= 0))
                if at:
                    met = met[self.arcs(state[at, word[met]], token[met])]
                state[end, word[met]] = token[met]
                node[met] = -1
                on = np.flatnonzero(node >= 0)
                if not len(on):
                    break
                word, node = word[on], node[on]
        if (state[sizes, np.arange(n)] < 0).any():
            raise ValueError("no path through the automaton")
        at, word, back = sizes.copy(), np.arange(n), []
        while len(word):
            token = state[at[word], word]
            back.append((word, token))
            at[word] -= self.length[token]
            word = word[at[word] > 0]
        owner = np.concatenate([w for w, _ in back[::-1]])
        ids = np.concatenate([t for _, t in back[::-1]])
        by_word = np.argsort(owner, kind="stable")
        flat = ids[by_word].astype("<u2").tobytes()
        ends = 2 * np.cumsum(np.bincount(owner, minlength=n))
        return [flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _alone(self, word: bytes) -> bytes:
        """The same steps for one long word."""
        state, spot_of, mask = [-1], self.keys, len(self.keys) - 1
        for end in range(1, len(word) + 1):
            node, found = 0, -1
            for at in range(end - 1, -1, -1):
                key = node << 8 | word[at]
                spot = (key * _GOLDEN & 2**64 - 1) >> (64 - self.bits)
                while spot_of[spot] not in (key, -1):
                    spot = (spot + 1) & mask
                if spot_of[spot] < 0:
                    break
                node = int(self.nodes[spot])
                token = int(self.token[node])
                if token >= 0 and (not at or (self.column[token] >= 0 and self.table[self.row[state[at]], self.column[token] >> 3] >> (self.column[token] & 7) & 1)):
                    found = token
                    break
            if found < 0:
                raise ValueError("no path through the automaton")
            state.append(found)
        ids, at = [], len(word)
        while at:
            ids.append(state[at])
            at -= int(self.length[ids[-1]])
        return np.array(ids[::-1], "<u2").tobytes()

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Whole texts: cut into words by the tokenizer's pattern, each of which takes its way through the automaton, unless this worker has met it before. The new words of a batch take it together."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.cut, self.known = automaton, cutter(PATTERN), {}
        special = automaton.special
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda text: [text]

    def words(self, text: str) -> list[str]:
        """The text's words and special tokens."""
        if not any(s in text for s in self.automaton.special):
            return self.cut(text)
        return [w for part in self.split(text) for w in ([part] if part in self.automaton.special else self.cut(part))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        ordinary = [w for w in new if w not in self.automaton.special]
        found = dict(zip(ordinary, self.automaton.words([w.encode() for w in ordinary]), strict=True))
        found |= {w: np.array([self.automaton.special[w]], "<u2").tobytes() for w in new if w in self.automaton.special}
        self.known |= found
        out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for w in found:
            if len(w) > WORD_CHARS:
                del self.known[w]
        return out


_automata: dict[str, Automaton] = {}
_shared: dict[tuple[str, str], object] = {}
_encoders: dict[str, Encoder] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a tokenizer file, built once in this process."""
    if path not in _automata:
        _automata[path] = Automaton.from_file(path)
    return _automata[path]


def _broadcast(path: str):
    sc = SparkSession.active().sparkContext
    key = path, sc.applicationId
    if key not in _shared:
        _shared[key] = sc.broadcast(automaton(path))
    return _shared[key]


def _encoder(path: str, shared) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(shared.value)
    return _encoders[path]


def encode(text: Column, path: str) -> Column:
    """Ids of each text (null: empty) as little-endian unsigned 32-bit integers in a binary column."""
    return round_trip(text, path)["ids"]


def round_trip(text: Column, path: str) -> Column:
    """``struct<ids, decoded>``: the ids of each text as by ``encode`` and the text that they decode to, by one Python worker."""
    shared = _broadcast(path)

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _encoder(path, shared)
        for texts in batches:
            ids = [wide(ids) for ids in words([t or "" for t in texts])]
            yield pd.DataFrame({"ids": [i.tobytes() for i in ids], "decoded": [words.automaton.decode(i.tolist()) for i in ids]})

    return both(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each binary column of ids; null gives the empty text."""
    shared = _broadcast(path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _encoder(path, shared)
        for values in batches:
            yield pd.Series([words.automaton.decode(np.frombuffer(v or b"", "<u4").tolist()) for v in values])

    return text(ids)
