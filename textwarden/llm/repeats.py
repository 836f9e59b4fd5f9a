"""Windows of a byte string, by their smallest k-gram; the arithmetic of ``suffix_dedup``."""

from __future__ import annotations

import numpy as np

#: Bytes whose windows are handled at once.
BLOCK = 2**22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 2 * len(have) if have is not None else 2**14)
        have = np.ones(size, "u8")
        have[1:] = base
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return sums


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ``starts`` to ``ends``: polynomials from running sums, mixed."""
    sums = _sums(data)
    return _mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts])


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-byte strings: a rolling polynomial, mixed."""
    sums = _sums(data)
    return _mixed((sums[k:] - sums[:-k]) * _power(_INVERSE, len(data) - k + 1))


def ranges(data: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The window starts as ranges (first, last) with the hash of the ``k``-gram that they share and its place.

    A window of ``width`` bytes belongs to the k-gram in it with the smallest hash, the leftmost
    of several, so equal windows belong to equal k-grams at the same distance. Consecutive
    windows of one k-gram form a range. No window if there are fewer than ``width`` bytes.
    """
    found = []
    for at in range(0, len(data) - width + 1, BLOCK):
        part = data[at : at + BLOCK + width - 1]
        h = gram_hashes(part, k)
        m = (h & np.uint64(2**64 - 2**24)) | np.arange(len(h), dtype="u8")
        span, step = width - k + 1, 1
        while 2 * step <= span:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if span > step:
            m = np.minimum(m[: len(m) - (span - step)], m[span - step :])
        owner = (m & np.uint64(2**24 - 1)).astype("i8")
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        last = np.concatenate([first[1:], [len(owner)]]) - 1
        found.append((first + at, last + at, h[owner[first]].view("i8"), owner[first] + at))
    if not found:
        return tuple(np.zeros(0, "i8") for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows of ``width`` bytes of ``data`` at ``starts`` are equal to another one of their group.

    A radix sort from the most significant digit on: each pass reads the next eight bytes of
    every window that is left, and windows that are alone with what they have begun with leave.
    """
    if len(data) < width:
        return np.zeros(len(starts), bool)
    digits = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left, label = np.arange(len(starts)), groups
    for at in [-1, *range(0, width - 8, 8), width - 8]:
        digit = digits[starts[left] + at] if at >= 0 else np.zeros(len(left), "u8")
        order = np.lexsort((digit, label))
        label, digit = label[order], digit[order]
        number = np.cumsum(np.concatenate([[0], (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])]))[: len(left)]
        several = np.bincount(number)[number] > 1
        left, label = left[order][several], number[several]
        if not len(left):
            break
    out = np.zeros(len(starts), bool)
    out[left] = True
    return out
