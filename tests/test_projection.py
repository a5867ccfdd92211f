import numpy as np
import pyarrow as pa
import pytest

from casekit.operators import projection as p


def clusters(n=300, dim=20, groups=6, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim)) * 2
    y = rng.integers(0, groups, n)
    return c[y] + 0.4 * rng.normal(size=(n, dim)), y


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i) if ids is None else ids[i], [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T
    np.fill_diagonal(near, -np.inf)
    return np.argsort(-near, axis=1, kind="stable")[:, :k]


def trustworthiness(x, y, k):
    """1 less the penalty for points that are near in y without being near in x."""
    n = len(x)
    ranks = np.empty((n, n), int)
    order = exact(x, n - 1)
    for i in range(n):
        ranks[i, order[i]] = np.arange(1, n)
    far = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, ranks[i, j] - k) for i in range(n) for j in near[i])


@pytest.mark.parametrize("kind", ["random", "copies"])
def test_neighbours_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = {"random": rng.normal(size=(300, 6)), "copies": np.repeat(rng.normal(size=(40, 8)), 8, axis=0)}[kind]
    edges = p.neighbour_graph(p.numbered(frame(spark, x), "id", "vec"), k=10).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(e.sim - u[e.u] @ u[e.v]) < 1e-6 and e.u != e.v for e in edges) and len(edges) == 10 * len(x)
    worst = np.array([(u[i] @ u[exact(x, 10)[i]].T).min() for i in range(len(x))])
    assert np.mean([e.sim >= worst[e.u] - 1e-6 for e in edges]) >= 0.9


def test_memberships_and_both_views(spark):
    edges = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (1, 0, 0.9), (1, 2, 0.4), (2, 1, 0.4), (2, 0, 0.5)], "u long, v long, sim double")
    got = {(r.u, r.v): r.w for r in p.fuzzy_graph(edges, 2).collect()}
    assert all(abs(got[a, b] - got[b, a]) < 1e-9 for a, b in got) and got[0, 1] == 1.0 and got[0, 2] == 1.0 and got[1, 2] < 1e-3


def test_points_keep_neighbourhoods_and_follow_the_seed(spark, monkeypatch):
    monkeypatch.setattr(p, "PART", 80)  # three parts
    x, _ = clusters(240)
    df = frame(spark, x)
    got = {r.id: r.point for r in p.projected(df, "id", "vec").collect()}
    points = np.array([got[i] for i in range(240)])
    assert points.shape == (240, 3) and np.isfinite(points).all() and trustworthiness(x, points, 10) > 0.9
    assert {r.id: r.point for r in p.projected(df.repartition(7), "id", "vec").collect()} == got


def test_small_and_odd_tables(spark):
    assert p.projected(frame(spark, np.zeros((0, 3))), "id", "vec").collect() == []
    one = p.projected(frame(spark, np.ones((1, 3))), "id", "vec", dims=2).collect()
    assert len(one) == 1 and len(one[0].point) == 2
    rows = [(None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (5, [0.0, 0.0]), (6, [1.0, 1.0])]
    out = p.projected(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec").collect()
    assert sorted((r.id is None, r.id or 0) for r in out) == [(False, 5), (False, 5), (False, 6), (True, 0)] and all(np.isfinite(r.point).all() for r in out)


def test_introductions_and_moves_by_arrow_batches():
    """whole batches as flat arrays, no Python object a number; pairs as of plain loops."""
    rng = np.random.default_rng(3)
    kind = pa.list_(pa.struct([("other", pa.int64()), ("x", pa.list_(pa.float32())), ("least", pa.float64())]))
    met = [[{"other": int(o), "x": [float(np.float32(a)) for a in rng.normal(size=4)], "least": float(rng.choice([-2, 0.5]))} for o in rng.permutation(50)[:m]] for m in (1, 2, 9)]
    (out,) = p._introduced(3)(iter([pa.RecordBatch.from_arrays([pa.array(met, kind)], ["met"])]))
    want = set()
    for group in met:
        for one in group:
            sims = sorted(((-np.dot(one["x"], o["x"]), o["other"]) for o in group if o is not one))[:3]
            want |= {(one["other"], v, round(-s, 9)) for s, v in sims if -s > one["least"]}
    assert {(r["u"], r["v"], round(r["sim"], 9)) for r in out.to_pylist()} == want and out.num_rows == len(want) > 5
    near = pa.list_(pa.struct([("v", pa.int64()), ("w", pa.float64()), ("y", pa.list_(pa.float64()))]))
    rows = pa.table({"node": [7, 2, 5], "y": [[9.0, 0.0], [0.0, 0.0], [0.0, 50.0]], "met": pa.array([[{"v": 2, "w": 1.0, "y": [0.0, 0.0]}], [{"v": 7, "w": 1.0, "y": [9.0, 0.0]}], None], near), "part": [0, 0, 0]})
    moved = {r["node"]: np.array(r["y"]) for r in p._moved(2, 0, 42, 0.5)(rows).to_pylist()}
    assert list(moved) == [2, 5, 7] and np.linalg.norm(moved[2] - moved[7]) < 5 and (moved[5] == [0, 50]).all()
