import random

import numpy as np
from pyspark.sql import functions as F

from casekit.llm import mixing


def targets_by_hand(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    rest, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
            open_.remove(s)
    return out


def docs(seed, n=400):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "tiny", "empty"]
    rows = []
    for i in range(n):
        s = rng.choices(names, [30, 10, 5, 3, 4, 0.5, 1])[0]
        rows.append((i, "" if s == "empty" else "w\t" * int(rng.lognormvariate(3, 1)) + "x", s))
    return rows + [(None, None, "b"), (5, "p q r", "a"), (5, "p q r", "a"), (7, "v " * 5000, "b")]


def test_targets(spark):
    for seed in (1, 2):
        rows = docs(seed)
        df = spark.createDataFrame(rows, "id long, t string, source string").withColumn("size", mixing.word_count("t"))
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        got = {r.source: r for r in mixing.source_targets(df).collect()}
        want = targets_by_hand(sizes)
        assert {s: r.source_size for s, r in got.items()} == sizes
        assert all(abs(got[s].target - want[s]) <= 1e-9 * max(1, want[s]) for s in sizes)


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(0)
    for n, stop in ((0, 2), (1, 2), (2, 2), (3, 2), (500, 2), (500, 12)):
        share, size = np.full(n, 0.37), rng.integers(1, 5, n).astype(float) if n % 2 else rng.lognormal(3, 1, n)
        out = mixing.flight(share, size, rng, stop)
        left = (out > 1e-9) & (out < 1 - 1e-9)
        assert left.sum() <= max(2, stop)
        assert abs(out.sum() - share.sum()) < 1e-6 and abs(out @ size - share @ size) < 1e-5 * max(1, size.sum())
        landed = mixing.settle(out, size, rng)
        assert set(np.round(landed, 9)) <= {0.0, 1.0}


def test_each_share_keeps_its_expectation():
    size = np.array([1.0, 2, 3, 5, 8, 13, 21, 34])
    runs = np.mean([mixing.flight(np.full(8, 0.5), size, np.random.default_rng(s)) for s in range(2000)], axis=0)
    assert np.abs(runs - 0.5).max() < 0.05


def settled(share, size, runs=2000):
    every = np.stack([mixing.settle(share, size, np.random.default_rng(s)) for s in range(runs)])
    assert set(np.unique(every)) <= {0.0, 1.0}
    return every


def test_settling_keeps_shares_and_totals():
    rng = np.random.default_rng(1)
    for sizes in (rng.lognormal(3, 1, 200), rng.lognormal(3, 1.5, 200), np.array([40.0, 60, 120] + [5.0] * 17), np.array([5000.0] + [50.0] * 199), rng.integers(1, 30, 40).astype(float)):
        share = rng.uniform(0.1, 0.9, len(sizes)) if len(sizes) == 40 else np.full(len(sizes), 0.4)
        runs = settled(share, sizes)
        assert np.abs(runs.mean(0) - share).max() < 0.05
        off = np.abs(runs @ sizes - share @ sizes)
        assert off.max() <= max(0.02 * (share @ sizes), 3 * np.median(sizes))


def test_a_document_that_outweighs_the_others_yields_to_the_total():
    sizes, share = np.array([100_000.0] + [10.0] * 99), np.full(100, 0.4)
    runs = settled(share, sizes, 50)
    assert (runs[:, 0] == 0).all() and (runs[:, 1:] == 1).all()  # 990 is as near to 40396 as it gets
    assert settled(np.zeros(0), np.zeros(0), 1).shape == (1, 0)


def test_shares_hold_over_blocks(spark):
    sizes = np.random.default_rng(2).lognormal(3, 1, 60).astype(int) + 1
    rows = [(i, f"s{k:04d}", int(n)) for k in range(900) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    for block in (20, 100):  # levels with a reserve, and one block
        out = mixing.mix_sources(df, size=F.col("n"), block=block).withColumn("ratio", F.col("target") / F.col("source_size"))
        means = out.groupBy("ratio", "doc_id").agg(F.avg("copies").alias("mean"), F.count("*").alias("n")).collect()
        assert {r.n for r in means} == {300}
        off = np.array([r.mean - r.ratio for r in means])
        assert np.abs(off).max() < 0.11 and np.abs(off).mean() < 0.03  # 300 draws: 0.029 by chance
        for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
            assert abs(r.t - r.g) <= 0.05 * r.g


def test_mix(spark):
    for block in (40, 1000):  # several levels of blocks, and one
        rows = docs(3, 1500)
        df = spark.createDataFrame([(s, t, i, 1, 2.0) for i, t, s in rows], "source string, text string, doc_id long, size int, target double")
        out = mixing.mix_sources(df, block=block)
        got = out.collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.size) for r in got) == sorted((-1 if i is None else i, len((t or "").split())) for i, t, _ in rows)
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
        for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"), F.count("*").alias("n")).collect():
            assert abs(r.t - r.g) <= (0.02 * r.g + 1 if r.n > 20 else r.m)
        again = mixing.mix_sources(df.repartition(7), block=block)
        key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
        assert sorted(map(key, again.collect())) == sorted(map(key, got))


def test_mixed_documents(spark):
    rows = docs(4, 300)
    df = spark.createDataFrame([(i, t, s, "extra") for i, t, s in rows], "doc_id long, text string, source string, copies string")
    taken = mixing.mix_sources(df).agg(F.sum("copies")).first()[0]
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and out.count() == taken
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0
