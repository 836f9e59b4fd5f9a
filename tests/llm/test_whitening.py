"""Whitening against a dense eigendecomposition, with nulls, non-finite entries, repeats, other dimensions and no rows."""

import math

import numpy as np
import pytest

from textwarden.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, key int, component string, n string, at int, p int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, "c", "n", 2, 3) for k, v in rows], SCHEMA)


def vectors(seed, rows, d, strong=0):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((rows, d)) * (1 + 3 * (np.arange(d) < strong)) * 0.2 + rnd.standard_normal(d)
    return [[float(c) for c in v] for v in x.astype("f4")]


def dense(rows, components, scale=256):
    """Scaled usable vectors with their keys, the distinct ones' number, sums, eigenvalues and vectors."""
    used = [(k, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({v for _, v in used}), dtype=float)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    sums = [sum(int(c) for c in column) for column in zip(*{v for _, v in used}, strict=True)]
    return used, len(x), sums, values[::-1][:components], vectors[:, ::-1][:, :components], values.sum()


def compare(spark, rows, components=4):
    used, n, sums, values, axes, trace = dense(rows, components)
    found = whitening.whiten(frame(spark, rows).repartition(3), components=components).collect()
    assert len(found) == len(used) * len(values)
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    by_key = {}
    for r in found:
        by_key.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-10)
    sign = np.zeros(len(values))
    for k, v in used:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        want = (np.array(v) - np.array(sums) / n) @ axes / np.sqrt(values)
        for i in range(len(values)):
            same = [w for d, w in by_key[k, i + 1] if d == deviation]
            assert same
            near = min(same, key=lambda w: abs(abs(w) - abs(want[i])))
            assert abs(near) == pytest.approx(abs(want[i]), abs=1e-6)
            if abs(want[i]) > 1e-3:
                sign[i] = sign[i] or np.sign(near * want[i])
                assert sign[i] == np.sign(near * want[i])


def test_wide_gap(spark):
    rows = [(i, v) for i, v in enumerate(vectors(1, 400, 40, strong=4))]
    compare(spark, rows)


def test_flat_spectrum(spark):
    """Noise alone: neighbouring eigenvalues are within a hundredth."""
    compare(spark, [(i, v) for i, v in enumerate(vectors(2, 3000, 64))])


def test_awkward_rows(spark):
    base = vectors(3, 60, 8)
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100, None), (101, [*base[0][:7], None]), (102, [*base[0][:7], float("nan")]), (103, [*base[0][:7], float("inf")]), (104, [float("-inf")] * 8)]
    rows += [(200 + i, base[0]) for i in range(30)] + [(5, base[5]), (None, base[6]), (300, [-0.0] * 8)]
    compare(spark, rows)
    shorter = [*rows, (400, [1.0, 2.0]), (401, [])]
    used = {k for k, *_ in dense(rows, 4)[0]}
    assert {r.vec_id for r in whitening.whiten(frame(spark, shorter)).collect()} == used


def test_few_dimensions(spark):
    compare(spark, [(i, v) for i, v in enumerate(vectors(4, 50, 3))], components=3)
    flat = [(i, [v, 2 * v, 1.0]) for i, v in enumerate([0.0, 0.5, 1.0, 4.0])]
    found = whitening.whiten(frame(spark, flat)).collect()
    assert {r.component for r in found} == {1} and all(r.explained == pytest.approx(1.0) for r in found)


def test_exact_beyond_a_long(spark):
    rows = [(i, [v, 1.0]) for i, v in enumerate([0.0, 2.0**20, 2.0**40])]
    found = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows), components=1).collect()}
    x = [[int(256 * v), 256] for _, (v, _) in rows]
    want = [sum((3 * c - s) ** 2 for c, s in zip(v, map(sum, zip(*x, strict=True)), strict=True)) for v in x]
    assert found == {i: (w if w < 2**63 else None) for i, w in enumerate(want)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_nothing_to_scale(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_filter_needs_fewer_passes_than_powers():
    """The recurrence on a plain matrix: certified, and in fewer products than the power method's bound."""
    rnd = np.random.default_rng(5)
    basis = np.linalg.qr(rnd.standard_normal((64, 64)))[0]
    values = np.concatenate([[1.03, 1.02, 1.015, 1.01], np.linspace(1.0, 0.8, 60)])
    matrix = basis * values @ basis.T

    class Plain:
        dimension, passes = 64, 0

        def times(self, q):
            self.passes += 1
            return matrix @ q

    plain = Plain()
    found, q = whitening.leading(plain, 4)
    assert np.abs(found - values[:4]).max() < 1e-12 and np.abs(np.abs(q.T @ basis[:, :4]) - np.eye(4)).max() < 1e-9
    assert plain.passes < 150
