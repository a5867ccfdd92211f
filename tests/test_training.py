import numpy as np
import pytest

from casekit.operators import training as t


def table(spark, n=600, dim=6, seed=0, classes=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(len(classes), dim)) * 2
    y = rng.choice(len(classes), n, p=[0.7, 0.2, 0.1][: len(classes)])
    x = centers[y] + rng.normal(size=(n, dim))
    rows = [([float(v) for v in x[i]], classes[y[i]], bool(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "a", False), (rows[0][0], None, False), (rows[0][0], "z", True), (rows[0][0], "a", None)], "v array<double>, y string, held boolean").repartition(4), x, y


@pytest.mark.parametrize("hidden", [(), (5,), (4, 3)])
def test_gradient_equals_finite_differences(hidden):
    rng = np.random.default_rng(1)
    layers = (3, *hidden, 4)
    theta = rng.normal(size=t.initial(layers, 0).size) * 0.5
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 4, 20), rng.random(20)
    _, g = t.loss_sum(theta, layers, x, y, w, 0.1)
    for i in range(len(theta)):
        move = np.zeros_like(theta)
        move[i] = 1e-6
        slope = (t.loss_sum(theta + move, layers, x, y, w, 0.1)[0] - t.loss_sum(theta - move, layers, x, y, w, 0.1)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-5 * max(1, abs(slope))


def test_sums_over_tasks_equal_one_pass(spark):
    df, x, y = table(spark)
    rows = df.where("v is not null and held is not null and y in ('a', 'b', 'c')").selectExpr("v as x", "ascii(y) - 97 as y", "held").repartition(37)
    layers, theta = (6, 5, 3), t.initial((6, 5, 3), 3)
    weights = np.array([0.5, 1.0, 2.0])
    g, train, val = t.epoch_sums(rows, theta, layers, weights)
    held = np.arange(len(y)) % 4 == 0
    loss, want = t.loss_sum(theta, layers, x[~held], y[~held], weights[y[~held]])
    total = weights[y[~held]].sum()
    assert np.allclose(g, want / total, atol=1e-12) and abs(train - loss / total) < 1e-12
    assert abs(val - t.loss_sum(theta, layers, x[held], y[held], weights[y[held]])[0] / weights[y[held]].sum()) < 1e-12


def test_adamw_against_its_definition():
    s = t.Settings(rate=0.1, weight_decay=0.2, l1=0.01, clip=1.0)
    theta = np.array([1.0, -2.0])
    state = t._State(0, theta, np.zeros(2), np.zeros(2), theta)
    m = v = np.zeros(2)
    for k, g in enumerate((np.array([3.0, 4.0]), np.array([0.1, -0.2])), 1):
        state = t.step(state, g, s)
        g = g + 0.01 * np.sign(theta)
        g = g / max(1.0, np.linalg.norm(g))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * 0.2 * theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        assert np.allclose(state.theta, theta, atol=1e-12) and state.epoch == k


def test_rates_rise_and_fall():
    s = t.Settings(epochs=10, rate=1.0, warmup=0.2, decay=True)
    assert [round(s.rate_at(e), 3) for e in range(10)] == [0.5, 1.0, 1.0, 0.875, 0.75, 0.625, 0.5, 0.375, 0.25, 0.125]


def test_smoothed_loss_and_patience_stop():
    s = t.Settings(smooth=0.5, patience=2)
    state = t._State(0, np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1))
    seen = []
    for epoch, loss in enumerate([1.0, 0.5, 0.9, 0.8, 0.1], 1):
        state = t.judged(t.replace(state, epoch=epoch, theta=np.array([float(epoch)])), loss, s)
        seen.append((state.signal, state.wait, state.best_epoch))
        if state.done:
            break
    assert seen == [(1.0, 0, 1), (0.75, 0, 2), (0.825, 1, 2), (0.8125, 2, 2)] and state.best[0] == 2.0


def test_learns_stops_early_and_scores(spark):
    df, x, y = table(spark)
    head = t.fit_network(df, "v", "y", "held", t.Settings(hidden=(16,), epochs=40, rate=0.1, patience=3, smooth=1.0))
    assert len(head.val_losses) < 40 and head.classes == ("a", "b", "c") and head.best_epoch == int(np.argmin(head.val_losses)) + 1
    out = t.score_network(df, head, "v").collect()
    known = [r for r in out if r.held and r.y in ("a", "b", "c")]
    assert np.mean([r.y_pred == r.y for r in known]) > 0.9 and len(out) == 604
    assert [(r.proba, r.y_pred) for r in out if r.v is None] == [(None, None)] and all(abs(sum(r.proba) - 1) < 1e-9 for r in known)


def test_a_broken_run_goes_on_as_if_unbroken(spark, tmp_path, monkeypatch):
    df, _, _ = table(spark, 200)
    s = t.Settings(hidden=(4,), epochs=6, rate=0.05, patience=99)
    whole = t.fit_network(df, "v", "y", "held", s, str(tmp_path / "a"))
    real, calls = t.epoch_sums, []

    def failing(*a):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(*a)

    monkeypatch.setattr(t, "epoch_sums", failing)
    path = str(tmp_path / "b")
    df.where("v is not null").count()
    # The same files, so that tasks see the same rows.
    import shutil

    shutil.copytree(tmp_path / "a" / "rows", tmp_path / "b" / "rows")
    with pytest.raises(RuntimeError):
        t.fit_network(df, "v", "y", "held", s, path)
    monkeypatch.setattr(t, "epoch_sums", real)
    again = t.fit_network(df, "v", "y", "held", s, path)
    assert np.array_equal(again.theta, whole.theta) and again.val_losses == whole.val_losses and len(again.train_losses) == 6


def test_no_validation_rows_wrong_inputs_and_saving(spark, tmp_path):
    df, _, _ = table(spark, 80)
    head = t.fit_network(df.where("not held"), "v", "y", "held", t.Settings(hidden=(), epochs=3))
    assert head.val_losses == () and head.best_epoch == 3 and len(head.train_losses) == 3
    t.save_head(spark, head, str(tmp_path / "h"))
    back = t.load_head(spark, str(tmp_path / "h"))
    assert back.layers == head.layers and np.array_equal(back.theta, head.theta) and back.classes == head.classes
    with pytest.raises(ValueError, match="classes"):
        t.fit_network(df.limit(0), "v", "y", "held")
    with pytest.raises(ValueError, match="entries"):
        t.fit_network(df.selectExpr("case when held then slice(v, 1, 2) else v end as v", "y", "held"), "v", "y", "held", t.Settings(epochs=1))
