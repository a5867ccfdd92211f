from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.operators import evaluate as e


@pytest.mark.parametrize("m", range(1, 7))
def test_distribution_of_u_against_enumeration(m):
    for n in range(1, 13 - m):
        counts = [0] * (m * n + 1)
        for ranks in combinations(range(1, m + n + 1), m):
            counts[sum(ranks) - m * (m + 1) // 2] += 1
        assert e.rank_sum_counts(min(m, n), max(m, n)) == counts
        for u in range(m * n + 1):
            far = sum(c for k, c in enumerate(counts) if abs(k - m * n / 2) >= abs(u - m * n / 2) - 1e-9)
            assert abs(e.exact_two_sided(m, n, u) - min(1.0, far / comb(m + n, m) if u * 2 != m * n else 1.0)) < 1e-12


def test_small_groups_are_exact_and_large_ones_agree_with_the_whole_table(spark):
    rng = np.random.default_rng(2)
    rows = [("small", float(v), i < 3) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7])]
    rows += [("tied", float(v), i % 2 == 0) for i, v in enumerate([1, 1, 2, 2, 3])] + [("one side", 1.0, True), ("one side", 2.0, True), (None, 3.0, True), (None, 4.0, False), ("small", None, True)]
    large = [("large", float(v), bool(g)) for v, g in zip(rng.normal(size=400).round(2), rng.random(400) < 0.4)]
    df = spark.createDataFrame(rows + large, "k string, v double, g boolean")
    got = {r.k: r for r in e.mann_whitney_by(df, ["k"], F.col("g"), "v").collect()}
    assert (got["small"].u, got["small"].exact) == (0.0, True) and abs(got["small"].p_value - 2 / 35) < 1e-12
    assert not got["tied"].exact and got["one side"].p_value is None and got["one side"].u is None and not got["one side"].exact
    assert got[None].exact and got[None].p_value == 1.0
    whole = e.mann_whitney(df.where("k = 'large'"), F.col("g"), "v").first()
    assert all(abs(got["large"][c] - whole[c]) < 1e-12 for c in ("u", "auc", "z", "p_value")) and not got["large"].exact
    assert e.mann_whitney_by(df.limit(0), ["k"], F.col("g"), "v").collect() == []


def test_quantiles_against_sums_of_masses():
    for n, p in ((1, 0.5), (7, 0.3), (40, 0.02), (300, 0.9)):
        upto = np.cumsum([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        for u in np.linspace(0.0005, 0.9995, 777):
            assert e.binomial_quantile(n, p, u) == int(np.searchsorted(upto, u))
    assert e.binomial_quantile(5, 1.0, 0.3) == 5 and e.binomial_quantile(5, 0.0, 0.3) == e.binomial_quantile(0, 0.4, 0.3) == 0
    assert abs(e.binomial_quantile(10**9, 0.25, 0.5) - 250_000_000) <= 1


def test_resamples_follow_the_multinomial(spark):
    cells = {(0, 0): 6, (0, 1): 3, (0, 2): 1, (1, 1): 4, (2, 0): 2, (2, 2): 3}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "y int, p int")
    runs = 4000
    rows = e.bootstrap_cells(df, "y", "p", runs).collect()
    counts = {}
    for r in rows:
        counts.setdefault((r.b, r.y_true), {})[r.y_pred] = r.n
    sizes = {y: sum(n for (a, _), n in cells.items() if a == y) for y in (0, 1, 2)}
    assert len(counts) == 3 * runs and all(sum(c.values()) == sizes[y] for (_, y), c in counts.items())
    # Chi-square of the joint counts of class 0 against the multinomial masses; rare ones together.
    seen, n = {}, sizes[0]
    for b in range(runs):
        c = counts[b, 0]
        key = (c.get(0, 0), c.get(1, 0))
        seen[key] = seen.get(key, 0) + 1
    chi, free, rest, rest_seen = 0.0, -1, 0.0, 0
    for i in range(n + 1):
        for j in range(n + 1 - i):
            want = runs * comb(n, i) * comb(n - i, j) * 0.6**i * 0.3**j * 0.1 ** (n - i - j)
            if want < 8:
                rest, rest_seen = rest + want, rest_seen + seen.get((i, j), 0)
            else:
                chi, free = chi + (seen.get((i, j), 0) - want) ** 2 / want, free + 1
    chi, free = chi + (rest_seen - rest) ** 2 / rest, free + 1
    assert chi < free + 4 * (2 * free) ** 0.5
    assert e.bootstrap_cells(df, "y", "p", 50).collect() == sorted(rows, key=lambda r: r.b)[: len([r for r in rows if r.b < 50])]


def test_cost_does_not_follow_the_rows(spark):
    many = spark.range(2_000_000).selectExpr("cast(id % 2 as int) as y", "cast(id % 3 > 0 as int) as p")
    rows = e.bootstrap_cells(many, "y", "p", 20).collect()
    assert len(rows) == 80 and all(abs(r.n - 1_000_000 * (2 if r.y_pred else 1) / 3) < 3000 for r in rows)
