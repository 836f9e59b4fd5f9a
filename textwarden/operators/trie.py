"""A dictionary as a trie in flat arrays, walked from all places of many texts at once."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: The end of a text is a code point that no word has.
END = 0x1FFFFF
#: Bytes of a trie beyond which a process keeps it in a file that is mapped, and words that are added to one together.
MAPPED, SLICE = 128_000_000, 500_000


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _mapped(array: np.ndarray) -> np.ndarray:
    """The array in a file without a name, so that its pages can leave memory."""
    with tempfile.TemporaryFile() as file:
        array.tofile(file)
        file.flush()
        return np.asarray(np.memmap(file, array.dtype, "r", shape=array.shape))


class Trie:
    """Nodes are numbered level by level, the root 0, a node's children one after the other by code point.

    Node i + 1 is reached by the code point ``codes[i]`` from the node p whose range from ``start[p]``
    to ``start[p + 1]`` has i; it ends a word of the cost ``prices[price[i]]`` unless ``price[i]`` is -1.
    These are 12 bytes a node. A large trie is mapped from a file by each process that unpickles it.
    """

    def __init__(self, codes: np.ndarray, start: np.ndarray, price: np.ndarray, prices: np.ndarray, longest: int):
        self.codes, self.start, self.price, self.prices, self.longest = codes, start, price, prices, longest

    @classmethod
    def of(cls, words: list[str], costs: list[float]) -> Trie:
        """A trie of non-empty words; of a word that is there twice the last cost counts."""
        found = dict(zip(words, costs, strict=True))
        words = sorted(found)
        return cls.of_sorted([(words, np.array([found[w] for w in words], "f8"))])

    @classmethod
    def of_sorted(cls, parts: Iterable[tuple[list[str], np.ndarray]]) -> Trie:
        """A trie of distinct words with their costs, by code point, in parts of which one at a time is looked at."""
        levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []  # code point, parent's place in the level above and cost of new nodes
        counts, last = [1], ""
        for words, costs in parts:
            words = [last, *words]  # its nodes are there
            codes, sizes = code_points(words), np.array([len(w) for w in words], "i8")
            first, costs = np.cumsum(sizes) - sizes, np.concatenate([[np.nan], costs])
            alive, node = np.arange(len(words)), np.zeros(len(words), "i4")
            for level in range(int(sizes.max())):
                alive = alive[sizes[alive] > level]
                if level == len(levels):
                    levels.append([])
                    counts.append(0)
                code, above = codes[first[alive] + level], node[alive]
                new = np.ones(len(alive), bool)
                new[1:] = (code[1:] != code[:-1]) | (above[1:] != above[:-1])
                new[0] = alive[0] > 0
                node[alive] = counts[level + 1] - 1 + np.cumsum(new)
                ended = sizes[alive] == level + 1
                value = np.full(len(alive), np.nan)
                value[ended] = costs[alive[ended]]  # of distinct words the one that ends at a node is the first of those through it
                levels[level].append((code[new], above[new], value[new]))
                counts[level + 1] += int(new.sum())
            last = words[-1]
        joined = lambda i, kind: np.concatenate([np.zeros(0, kind), *(x[i] for level in levels for x in level)]).astype(kind)
        codes = joined(0, "u4")
        children = [np.bincount(np.concatenate([x[1] for x in level]), minlength=n) for level, n in zip(levels, counts, strict=False)]
        start = np.zeros(len(codes) + 2, "i4")
        np.cumsum(np.concatenate([np.zeros(0, "i8"), *children, np.zeros(counts[-1], "i8")]), out=start[1:])
        costs = joined(2, "f8")
        ends = ~np.isnan(costs)
        prices, which = np.unique(costs[ends], return_inverse=True)
        price = np.full(len(codes), -1, "i4")
        price[ends] = which
        return cls(codes, start, price, prices, len(levels))

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """What the trie can be made of again."""
        return self.codes, self.start, self.price, self.prices, self.longest

    def __reduce__(self):
        return _received, self.parts()

    def children(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by each code point, 0 where there is none."""
        out, low, high = np.zeros(len(nodes), "i4"), self.start[nodes], self.start[nodes + 1]
        rest = np.flatnonzero(low < high)
        low, high, codes = low[rest], high[rest], codes[rest]
        while len(rest):
            middle = (low + high) >> 1
            found = self.codes[middle]
            hit = found == codes
            out[rest[hit]] = middle[hit] + 1
            right = found < codes
            low, high = np.where(right, middle + 1, low), np.where(right, high, middle)
            on = np.flatnonzero(~hit & (low < high))
            rest, low, high, codes = rest[on], low[on], high[on], codes[on]
        return out

    def _first(self, codes: np.ndarray) -> np.ndarray:
        """The root's child by each code point, 0 where there is none."""
        known = self.codes[: self.start[1]]
        if not len(known):
            return np.zeros(len(codes), "i4")
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, at + 1, 0).astype("i4")

    def matches(self, codes: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length up to ``reach``: where words of that length begin in ``codes``, and their costs."""
        at, node = np.arange(len(codes), dtype="i4"), np.zeros(len(codes), "i4")
        for n in range(1, min(reach, self.longest) + 1):
            if n > 1 and len(at) and at[-1] + n > len(codes):
                inside = at + n <= len(codes)
                at, node = at[inside], node[inside]
            child = self.children(node, codes[at + (n - 1)]) if n > 1 else self._first(codes)
            on = child > 0
            at, node = at[on], child[on]
            if not len(at):
                return
            price = self.price[node - 1]
            ends = price >= 0
            yield n, at[ends], self.prices[price[ends]]


def _received(codes: np.ndarray, start: np.ndarray, price: np.ndarray, prices: np.ndarray, longest: int) -> Trie:
    arrays = [codes, start, price]
    if sum(a.nbytes for a in arrays) > MAPPED:
        arrays = [_mapped(a) for a in arrays]
    return Trie(*arrays, prices, longest)


class Texts:
    """Texts one after the other as code points, each with ``END`` behind it."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts], "i8")
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.codes = np.full(int(self.sizes.sum()) + len(texts), END, "u4")
        inside = np.ones(len(self.codes), bool)
        inside[self.first + self.sizes] = False
        self.codes[inside] = code_points(texts)

    def __iter__(self) -> Iterator[tuple[str, int]]:
        return zip(self.texts, self.first.tolist(), strict=True)


def least_costs(first: np.ndarray, sizes: np.ndarray, costs: np.ndarray, sign: int, few: int = 8) -> np.ndarray:
    """For each place of ragged texts the length of the piece that the cheapest cut puts there, the shortest of equals.

    ``costs[p, n - 1]`` is the cost of the piece of length n that ends (``sign`` 1, from the left) or
    begins (-1, from the right) at place p. All texts take a step together; once fewer than ``few``
    are left these go on one by one.
    """
    order = np.argsort(-sizes, kind="stable")
    start, size = (first if sign > 0 else first + sizes)[order], sizes[order]
    reach = costs.shape[1]
    best, pick = np.zeros(len(costs)), np.ones(len(costs), "i4")
    back = sign * np.arange(1, reach + 1)
    step, active = 1, int((size > 0).sum())
    while active and (active >= few or step <= reach):
        at, m = start[:active] + sign * step, min(reach, step)
        total = best[at[:, None] - back[:m]] + costs[at, :m]
        n = total.argmin(axis=1)
        best[at], pick[at] = total[np.arange(active), n], n + 1
        step += 1
        active = int(np.searchsorted(-size, -step, side="right"))
    for i in range(active):
        s, e = int(start[i]), int(size[i])
        places = slice(s, s + e + 1) if sign > 0 else slice(s - e, s + 1)
        rows, values = costs[places].tolist(), best[places].tolist()
        if sign < 0:
            rows, values = rows[::-1], values[::-1]
        chosen = []
        for j in range(step, e + 1):
            row = rows[j]
            least, k = values[j - 1] + row[0], 1
            for n in range(2, reach + 1):
                cost = values[j - n] + row[n - 1]
                if cost < least:
                    least, k = cost, n
            values[j] = least
            chosen.append(k)
        pick[s + sign * np.arange(step, e + 1)] = chosen
    return pick
