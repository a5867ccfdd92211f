from itertools import product

import numpy as np
import pytest

from casekit.operators import owen


def factory():
    """What makes the classifier in a worker: nested, as workers don't import tests."""

    def make():
        import numpy as np

        def predict(texts):
            """Products and differences of words: far from additive."""
            out = []
            for t in texts:
                a, b, c = (t.split().count(w) for w in "abc")
                out.append([np.tanh(0.3 * a * b - 0.2 * c + 0.1 * a * c * c), a * (b + 1.0), c - 2.0 * a])
            return np.array(out).reshape(-1, 3)

        return predict

    return make


predict = factory()()


def masked(sentences, on):
    return " ".join((s or "") if k else "..." for s, k in zip(sentences, on))


def enumerated(sentences):
    """Owen values by definition: over all contexts of siblings on the way to a sentence."""
    n = len(sentences)
    f = lambda on: predict([masked(sentences, [i in on for i in range(n)])])[0]

    def way(lo, hi, i):
        if hi - lo == 1:
            return []
        mid = (lo + hi) // 2
        return [range(mid, hi), *way(lo, mid, i)] if i < mid else [range(lo, mid), *way(mid, hi, i)]

    out = []
    for i in range(n):
        siblings, total = way(0, n, i), 0.0
        for picks in product((0, 1), repeat=len(siblings)):
            on = {j for s, k in zip(siblings, picks) if k for j in s}
            total = total + (f(on | {i}) - f(on)) / 2 ** len(siblings)
        out.append(total)
    return np.array(out)


def docs(spark, rows):
    return spark.createDataFrame(rows, "case_id string, sentences array<string>").repartition(3)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(list("abcd"), rng.integers(0, 4))) for _ in range(n)]


def test_equals_enumeration(spark):
    rows = [(f"d{n}", texts(n, n)) for n in range(1, 11)]
    got = {r.case_id: r for r in owen.owen_values(docs(spark, rows), factory(), max_evals=5000).collect()}
    for case, sentences in rows:
        assert np.allclose(got[case]["values"], enumerated(sentences), atol=1e-12), case


@pytest.mark.parametrize("budget", [0, 2, 4, 9, 30])
def test_values_add_up_at_any_budget_which_holds(spark, budget, tmp_path):
    rows = [(f"d{n}", texts(n, 50 + n)) for n in (1, 2, 3, 7, 40)]
    log = str(tmp_path)

    make = factory()

    def counting():
        import os
        import uuid

        inner = make()

        def run(batch):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(str(len(batch)))
            return inner(batch)

        return run

    got = {r.case_id: r for r in owen.owen_values(docs(spark, rows), counting, max_evals=budget).collect()}
    for case, sentences in rows:
        gap = predict([masked(sentences, [True] * len(sentences))])[0] - predict([masked(sentences, [False] * len(sentences))])[0]
        values = np.array(got[case]["values"])
        assert values.shape == (len(sentences), 3) and np.allclose(values.sum(0), gap, atol=1e-9)
    used = sum(int(p.read_text()) for p in tmp_path.iterdir())
    full = {1: 2, 2: 4, 3: 2 + 2 * (1 + 2), 7: 10**9, 40: 10**9}  # evaluations of whole small trees
    assert used <= sum(min(max(budget, 2), full[len(s)]) for _, s in rows)


def test_largest_change_is_split_first(spark):
    sentences = ["x"] * 4 + ["x", "a b", "x", "x"]
    flat = lambda: lambda ts: np.array([[float("a b" in t)] for t in ts])
    values = owen.owen_values(docs(spark, [("d", sentences)]), flat, max_evals=2 + 2 + 4 + 8).first()["values"]
    assert [round(v[0], 9) for v in values] == [0, 0, 0, 0, 0, 1, 0, 0]


def test_widths():
    assert owen.widths(0) == owen.widths(3) == [] and owen.widths(4) == [1] and owen.widths(200) == [1, 2, 4, 8, 16, 32, 36]


def test_empty_null_and_repeated_rows(spark):
    rows = [(None, None), ("e", []), ("r", ["a b", None, "c"]), ("r", ["a b", None, "c"])]
    got = owen.owen_values(docs(spark, rows), factory()).collect()
    assert len(got) == 4 and sorted(len(r["values"]) for r in got) == [0, 0, 3, 3]
    assert len({str(r["values"]) for r in got if r.case_id == "r"}) == 1
    assert owen.owen_values(docs(spark, []), factory()).collect() == []


def test_documents_are_folded_by_batches(spark):
    """No Python call a document (F6): sizes are mixed within a batch, and values still add up."""
    rows = [(str(i), texts(i % 5, i)) for i in range(200)]
    out = owen.owen_values(docs(spark, rows).coalesce(1), factory(), max_evals=12)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.case_id: r for r in out.collect()}
    assert len(got) == 200
    for case, sentences in rows:
        assert np.allclose(np.array(got[case]["values"]).reshape(-1, 3), np.reshape(enumerated(sentences), (-1, 3)), atol=1e-12), case
