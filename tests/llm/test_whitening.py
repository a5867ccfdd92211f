import math
from fractions import Fraction

import numpy as np
import pytest

from casekit.llm import whitening as w


def by_hand(rows):
    """(id, x) of the usable rows, the fit list, its exact sums and covariance as fractions."""
    used = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = list({x for _, x in used})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    centred = [[n * x[j] - sums[j] for j in range(dim)] for x in fit]
    cov = [[Fraction(sum(c[i] * c[j] for c in centred), n**3) for j in range(dim)] for i in range(dim)]
    return used, n, sums, cov


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def vectors(n, dim, seed, offset=0.0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) + offset
    return [[float(np.float32(c)) for c in v] for v in mixed]


@pytest.mark.parametrize("offset", [0.0, 3000.0])
def test_against_exact_arithmetic(spark, offset):
    vs = vectors(60, 9, 4, offset)
    rows = list(enumerate(vs)) + [(100 + i, vs[7]) for i in range(30)] + [(None, vs[8]), (200, None), (201, [1.0] * 8 + [None]), (202, [float("nan")] * 9), (203, [float("inf")] + [0.0] * 8)]
    used, n, sums, cov = by_hand(rows)
    got = w.whiten(table(spark, rows).repartition(5)).collect()
    assert len(got) == 4 * len(used) and n == 60 and {r.n for r in got} == {60}
    x_of = dict(used)
    for r in got:
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x_of[r.vec_id], sums))
    v = np.array([[float(c) for c in row] for row in cov])
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1], vecs[:, ::-1]
    trace = float(sum(cov[i][i] for i in range(9)))
    for c in range(4):
        mine = {r.vec_id: r for r in got if r.component == c + 1}
        want = {i: sum((n * a - s) / n * b for a, s, b in zip(x, sums, vecs[:, c])) / math.sqrt(values[c]) for i, x in used}
        sign = 1 if mine[0].whitened * want[0] > 0 else -1
        assert max(abs(sign * mine[i].whitened - want[i]) for i in want) < 1e-9
        assert abs(mine[0].explained - values[c] / trace) < 1e-12 and mine[0].identity_error < 1e-10


def test_covariance_is_compensated(spark):
    """Sums that lose all digits in doubles keep them in high and low parts."""
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, size=(3000, 4)) + 2**50
    rows = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "id long, x array<long>").repartition(40)
    sums = tuple(int(s) for s in x.astype(object).sum(axis=0))
    high, low = w._covariance(rows, 4, 3000, sums)  # 40 tasks: merged in two levels
    centred = 3000 * x.astype(object) - np.array(sums, dtype=object)
    exact = centred.T @ centred
    for i in range(4):
        for j in range(4):
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - int(exact[i, j])) <= Fraction(abs(int(exact[i, i])), 2**95)


def test_slices_and_sums_are_error_free():
    rng = np.random.default_rng(2)
    for c in (rng.integers(-(2**61), 2**61, (50, 3)), np.array([[2**70, -(2**80) - 1]], dtype=object), np.zeros((0, 2), np.int64)):
        parts = w.slices(c)
        back = [sum(int(v) << k * w.SLICE_BITS for k, v in enumerate(vs)) for vs in zip(*[p.ravel() for p in parts])]
        assert back == [int(v) for v in c.ravel()] and all(np.abs(p).max(initial=0) <= 2**w.SLICE_BITS for p in parts)
    a, b = rng.normal(size=100) * 1e10, rng.normal(size=100)
    s, e = w.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(p) + Fraction(q) for x, y, p, q in zip(a, b, s, e))


@pytest.mark.parametrize("case", ["random", "ones", "identity", "zero", "glued", "clustered", "graded", "one"])
def test_divide_and_conquer(case):
    rng = np.random.default_rng(3)
    wilkinson = np.diag(np.abs(np.arange(-10, 11)).astype(float)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    glued = np.kron(np.eye(3), wilkinson)
    for i in (21, 42):
        glued[i - 1, i] = glued[i, i - 1] = 1e-9
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    x = rng.normal(size=(200, 64))
    a = {
        "random": x.T @ x, "ones": np.ones((30, 30)), "identity": np.eye(12), "zero": np.zeros((5, 5)), "glued": glued, "one": np.array([[3.0]]),
        "clustered": q @ np.diag(np.r_[np.ones(15), np.linspace(1, 1 + 1e-14, 15)]) @ q.T, "graded": q @ np.diag(10.0 ** -np.arange(30)) @ q.T,
    }[case]
    d, e, q = w.tridiagonal(a)
    values, inner = w.tridiagonal_eigen(d, e)
    u, size = q @ inner, max(np.abs(a).max(), 1e-300) * len(a)
    assert np.abs(a @ u - u * values).max() <= 1e-13 * size
    assert np.abs(u.T @ u - np.eye(len(a))).max() < 1e-12
    assert np.abs(np.sort(values) - np.linalg.eigvalsh(a)).max() <= 1e-13 * size


def test_edge_cases(spark):
    assert w.whiten(table(spark, []).coalesce(1)).collect() == []
    assert w.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    one = w.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, None)}
    flat = w.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [9.0]), (4, [-0.0, 1e30])]).limit(3)).collect()
    assert {r.vec_id for r in flat} == {1, 2} and sorted(r.whitened for r in flat if r.component == 1) == [-1.0, 1.0]
    assert {r.whitened for r in flat if r.component == 2} == {None} and flat[0].identity_error < 1e-12
    wide = spark.createDataFrame([(float(i), f"k{i}", [i * 1.5, -i * i / 7]) for i in range(6)], "n double, vec_id string, embedding array<double>")
    out = w.whiten(wide)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and {r.vec_id for r in out.collect()} == {f"k{i}" for i in range(6)}
    far = w.whiten(table(spark, [(i, [float(i) * 1e15, 1.0]) for i in range(5)])).collect()
    assert {r.deviation for r in far if r.vec_id in (0, 4)} == {None} and all(abs(r.whitened) < 2 for r in far if r.component == 1)
