"""Whitening of embeddings: exact sums, a compensated covariance, a divide-and-conquer
eigen-solver.

Entries are fixed-point integers x. The covariance is summed from centred products
(n x - S)(n x - S)', whose entries are integers too. Tasks cut them into slices of so few
bits that sums of products of slices are exact in doubles, and add those sums up in
double-double: the rounding error of each addition is found by an error-free transformation
and kept as a low part. High and low parts are merged across tasks. What reaches the driver
is a few matrices of the vectors' dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import discard, drop_worker_caches, materialize

#: Entries are multiples of 1 / SCALE.
SCALE = 256
#: Rows whose products are summed at once, as a power of two, and bits of a slice: products
#: of two slices, summed over the rows, stay below 2 ** 53.
ROWS_BITS = 11
SLICE_BITS = (53 - ROWS_BITS) // 2
#: Partial matrices that are merged at once, and that come to the driver at most.
FAN = 16
_EPS = np.finfo(float).eps


# Double-double numbers: pairs (high, low) of arrays.


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what rounding left out, exactly."""
    s = a + b
    part = s - a
    return s, (a - (s - part)) + (b - part)


def add_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-double arrays."""
    high, rest = two_sum(a[0], b[0])
    low, rest2 = two_sum(a[1], b[1])
    high, low = two_sum(high, rest + low)
    return two_sum(high, low + rest2)


def slices(centred: np.ndarray) -> list[np.ndarray]:
    """Doubles s_0, s_1, ... of ``SLICE_BITS`` bits each, with sum s_k 2 ** (k SLICE_BITS)
    equal to the integers ``centred`` (int64, or Python's where these don't do); the last
    one has the sign."""
    most = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
    count = max(1, -(-most.bit_length() // SLICE_BITS))
    mask, out = (1 << SLICE_BITS) - 1, []
    for k in range(count):
        part = centred >> (k * SLICE_BITS)
        out.append((part if k == count - 1 else part & mask).astype(np.float64))
    return out


def add_products(total: tuple[np.ndarray, np.ndarray], centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``total`` plus the sum of the rows' outer products, for at most 2 ** ROWS_BITS rows."""
    parts = slices(centred)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            g = a.T @ parts[j]  # integers under 2 ** 53: exact
            g = np.ldexp(g if i == j else g + g.T, (i + j) * SLICE_BITS)
            total = add_pairs(total, (g, np.zeros_like(g)))
    return total


# Tridiagonal form, and its eigenvectors by divide and conquer.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with a = Q T Q', by reflections."""
    a, n = np.array(a, dtype=float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, v[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z_j^2 / (d_j - x), one after each pole d (rising, apart).

    Returns (origin, shift): root i is d[origin[i]] + shift[i], measured from its nearer
    pole, so that its distances to all poles are accurate.
    """
    k = len(d)
    weight, total = rho * z * z, rho * float(z @ z)
    right = np.append(d[1:], d[-1] + total)
    half = (right - d) / 2
    f = lambda origin, shift: 1 + (weight / ((d[None, :] - d[origin][:, None]) - shift[:, None])).sum(axis=1)
    here = np.arange(k)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = (f(here, half) >= 0) | (here == k - 1)
        origin = np.where(left, here, np.minimum(here + 1, k - 1))
        low = np.where(left, 0.0, -half)
        high = np.where(left, np.where(here == k - 1, 2 * half, half), 0.0)
        for _ in range(220):  # halves until neighbours in doubles, also far below a gap
            mid = (low + high) / 2
            up = f(origin, mid) >= 0
            low, high = np.where(up, low, mid), np.where(up, mid, high)
            if np.all((mid == low) & (mid == high)):
                break
    return origin, np.where(left, high, low)


def _merge(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of q (diag(d) + rho z z') q'."""
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order], q[:, order]
    size = np.linalg.norm(z)
    z, rho = z / size, rho * size * size
    tiny = 8 * _EPS * max(np.abs(d).max(), np.abs(z).max(), rho)
    keep, last = [], None
    for i in range(len(d)):  # what couples to nothing is an eigenvector as it is
        if rho * abs(z[i]) <= tiny:
            continue
        if last is not None:
            tau = np.hypot(z[i], z[last])
            c, s = z[i] / tau, -z[last] / tau
            if abs((d[i] - d[last]) * c * s) <= tiny:  # poles that coincide: turn one away
                z[i], z[last] = tau, 0.0
                a, b = q[:, last].copy(), q[:, i].copy()
                q[:, last], q[:, i] = c * a + s * b, c * b - s * a
                d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                keep.remove(last)
        keep.append(i)
        last = i
    if not keep:
        return d, q
    keep = sorted(keep, key=lambda i: d[i])
    poles, zk = d[keep], z[keep]
    origin, shift = _secular(poles, zk, rho)
    apart = (poles[origin][None, :] - poles[:, None]) + shift[None, :]  # root i less pole j, at [j, i]
    gaps = poles[None, :] - poles[:, None]
    np.fill_diagonal(gaps, 1.0)
    with np.errstate(divide="ignore"):
        sizes = np.log(np.abs(apart)).sum(axis=1) - np.log(np.abs(gaps)).sum(axis=1)
    # The z for which these roots are exact: its vectors are orthogonal to working precision.
    exact = np.copysign(np.exp((sizes - np.log(rho)) / 2), zk)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = exact[:, None] / -apart
    stuck = ~np.isfinite(u)
    u[:, stuck.any(axis=0)] = stuck[:, stuck.any(axis=0)]
    u /= np.linalg.norm(u, axis=0)
    d[keep], q[:, keep] = poles[origin] + shift, q[:, keep] @ u
    return d, q


def tridiagonal_eigen(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (columns) of the symmetric tridiagonal matrix of ``d`` and
    off-diagonal ``e``, by halving it and merging the halves' solutions by a rank-one update."""
    n = len(d)
    if n == 1:
        return np.array(d, dtype=float), np.eye(1)
    m = n // 2
    rho = abs(float(e[m - 1]))
    first, second = np.array(d[:m], dtype=float), np.array(d[m:], dtype=float)
    first[-1] -= rho
    second[0] -= rho
    d1, q1 = tridiagonal_eigen(first, e[: m - 1])
    d2, q2 = tridiagonal_eigen(second, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    both = np.concatenate([d1, d2])
    if rho == 0:
        return both, q
    return _merge(both, np.concatenate([q1[-1], np.sign(e[m - 1]) * q2[0]]), rho, q)


def eigen(high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric matrix high + low, falling, and their
    unit vectors (columns), each with its largest entry positive.

    Solved in doubles, then each vector is corrected once by its residual against high + low
    in extended precision, along the other vectors.
    """
    scale = float(np.abs(high).max(initial=0.0)) or 1.0
    d, e, q = tridiagonal(high / scale)
    values, inner = tridiagonal_eigen(d, e)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], (q @ inner)[:, order]
    wide = (high.astype(np.longdouble) + low) / scale
    out_values, out = [], []
    for i in range(min(k, len(values))):
        v = vectors[:, i].astype(np.longdouble)
        v /= np.sqrt(v @ v)
        value = v @ (wide @ v)
        turns = (vectors.T @ (wide @ v - value * v)).astype(float)
        gap = float(value) - values
        near = np.abs(gap) <= 64 * _EPS * max(np.abs(values).max(), _EPS)  # any vector of a common space will do
        v = v + vectors @ np.where(near, 0.0, turns / np.where(near, 1.0, gap))
        v /= np.sqrt(v @ v)
        out_values.append(float(v @ (wide @ v)) * scale)
        at = int(np.argmax(np.abs(v)))
        out.append(np.asarray(v * np.sign(v[at]), dtype=float))
    return np.array(out_values), np.array(out).T.reshape(len(high), -1)


# The statistics of a table of vectors.


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learnt: ``n`` distinct vectors, their exact ``sums``, the ``values``
    and ``vectors`` (columns) of the largest components, the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e), or NaN for a component without spread, which can't be whitened."""
        spread = self.values > len(self.sums) * _EPS * max(self.trace, 0.0)
        return np.where(spread, 1 / np.sqrt(np.where(spread, self.values, 1.0)), np.nan)


def usable(vector: Column | str) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fine = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  (NaN is greater)
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def fixed_point(vector: Column | str) -> Column:
    """floor(SCALE * c) of each entry as long; what a long can't hold ends at its bounds."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(``id``, ``x``) of the usable rows, and the vectors' dimension: the commonest one
    (the larger on a tie). Rows of another dimension are left out like unusable ones."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(usable("v") & (F.size("v") > 0))
    top = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = top["dim"] if top else 0
    return rows.where(F.size("v") == dim).select("id", fixed_point("v").alias("x")), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: in int64 where that holds it, else as Python's integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max((abs(int(s)) for s in sums), default=0) < 2**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _sums(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [n], "high": [high.tolist()], "low": [low.tolist()]})

    return run


def _products(dim: int, n: int, sums: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        total, center, some = (np.zeros((dim, dim)), np.zeros((dim, dim))), np.array(sums, dtype=object), False
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), 1 << ROWS_BITS):
                total, some = add_products(total, _centred(x[at : at + (1 << ROWS_BITS)], n, center)), True
        if some:
            upper = np.triu_indices(dim)
            yield pa.RecordBatch.from_pydict({"high": [total[0][upper]], "low": [total[1][upper]]}, schema=pa.schema([("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))]))

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = None
    for high, low in zip(rows["high"], rows["low"]):
        pair = np.asarray(high, float), np.asarray(low, float)
        total = pair if total is None else add_pairs(total, pair)
    return pd.DataFrame({"high": [total[0]], "low": [total[1]]})


def _covariance(fit: DataFrame, dim: int, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """n ** 3 times the covariance, in double-double. Tasks' matrices are merged ``FAN`` at a
    time on the executors until as many are left."""
    parts = materialize(fit.select("x").mapInArrow(_products(dim, n, sums), "high array<double>, low array<double>"), "products")
    while (count := parts.count()) > FAN:
        groups = -(-count // FAN)
        merged = parts.groupBy(F.pmod(F.xxhash64("high", "low"), F.lit(groups)).alias("g")).applyInPandas(_added, "high array<double>, low array<double>")
        after = materialize(merged, "products")
        discard(parts)
        parts = after
    rows = parts.toPandas()
    discard(parts)
    total = _added(rows)
    out = []
    for name in ("high", "low"):
        a = np.zeros((dim, dim))
        a[np.triu_indices(dim)] = total[name][0]
        out.append(a + np.triu(a, 1).T)
    return out[0], out[1]


def fit_whitening(rows: DataFrame, dim: int, k: int = 4) -> tuple[Whitening, DataFrame] | None:
    """Components of the distinct vectors ``x`` (array of long, ``dim`` entries) of ``rows``,
    and the table of these vectors, written to the shared folder. None for no rows.

    A vector that very many rows share counts once: copies are dropped before the shuffle.
    """
    if not dim:
        return None
    fit = materialize(rows.select("x").distinct(), "distinct_vectors")
    parts = fit.mapInArrow(_sums(dim), "n long, high array<long>, low array<long>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    found = parts.select("at", "n", "s.*").groupBy("at").agg(F.sum("n").alias("n"), wide("high"), wide("low")).orderBy("at").collect()
    n = int(found[0]["n"])
    sums = tuple((int(r["high"]) << 32) + int(r["low"]) for r in found)
    high, low = _covariance(fit, dim, n, sums)
    # In units of 1 / n ** 3, which scales values only.
    values, vectors = eigen(high, low, k)
    cube = float(n) ** 3
    trace = float(np.trace(high.astype(np.longdouble) + low)) / cube
    return Whitening(n, sums, np.maximum(values, 0.0) / cube, vectors, trace), fit


def _whitened(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centred = _centred(x, model.n, np.array(model.sums, dtype=object))
    return centred, (centred.astype(np.float64) / model.n) @ model.vectors * model.scales


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly; None beyond a long."""
    most = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
    if most * most * max(centred.shape[1], 1) < 2**63:
        return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in centred)]


def _applied(model: Whitening, components: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dim, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            centred, y = _whitened(model, _matrix(batch.column(batch.num_columns - 1), dim))
            if not components:
                yield pa.RecordBatch.from_arrays([pa.array(list(y), pa.list_(pa.float64()))], ["y"])
                continue
            each = np.repeat(np.arange(len(y)), k)
            flat = y.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(_deviations(centred), pa.int64()).take(pa.array(each)), pa.array(flat, mask=np.isnan(flat)),
                ],
                ["id", "component", "deviation", "whitened"],
            )

    return run


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of (covariance of the whitened fit list - identity), over
    the components that have spread; None if none has. A centred aggregate on Spark."""
    with_spread = [i for i, s in enumerate(model.scales) if not np.isnan(s)]
    if not with_spread:
        return None
    y = fit.select("x").mapInArrow(_applied(model, False), "y array<double>")
    pairs = [(i, j) for i in with_spread for j in with_spread if i <= j]
    row = y.agg(*[F.covar_pop(F.get("y", F.lit(i)), F.get("y", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4) -> DataFrame:
    """One row per usable row of ``vectors`` and component up to ``k``: id, ``component`` (int,
    from 1, by falling spread), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, empty, or has a null or non-finite entry, or has another than
    the commonest dimension, are left out. Ids may be null or repeated; each row gives its
    own results, equal vectors equal ones. ``whitened`` is null for a component without
    spread (as of one distinct vector), ``explained`` is 0 where no component has any,
    ``deviation`` is null where it exceeds a long. Equal eigenvalues come in any order. An
    empty table gives none.
    """
    rows, dim = integers(vectors, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    found = fit_whitening(rows, dim, k)
    if found is None:
        return rows.where("false").select(F.col("id").alias(id_col), F.expr("cast(null as int) as component"), *[F.expr(f"cast(null as {t}) as {c}") for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    model, fit = found
    error = identity_error(fit, model)
    discard(fit)
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else 0.0) for v in model.values])
    out = rows.select("id", "x").mapInArrow(_applied(model, True), f"id {kind}, component int, deviation long, whitened double")
    return out.select(
        F.col("id").alias(id_col), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
