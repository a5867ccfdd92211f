import pytest
from pyspark.sql import functions as F

from casekit.operators import curate


def test_availability(spark):
    df = spark.createDataFrame([("JP_LISBOA", None), ("TRP", None), ("TRL", "S"), (None, None), (None, "N")], "tribunal string, texto_integral_disponivel string")
    assert sorted(r[0] or "" for r in curate.keep_available(df).collect()) == ["", "JP_LISBOA", "TRL"]
    assert {r[1] for r in curate.drop_unavailable(df).collect()} == {None, "S"}


def test_keep_first_is_deterministic(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (0, None), (5, "b")], "_row_id int, n_processo string")
    for parts in (1, 4):
        got = {(r.n_processo, r._row_id) for r in curate.keep_first(df.repartition(parts), ["n_processo"], ["_row_id"]).collect()}
        assert got == {("a", 1), (None, 0), ("b", 5)}


def test_views_do_not_leak(spark):
    names = ["url", "tribunal", "n_processo", "juiz_relator", "data_acordao", "descritores", "decisao", "texto_integral_sem_decisao", "sumario", "texto_integral_completo", "decisao_extraida_do_texto_integral"]
    classification, descriptive = curate.views(spark.createDataFrame([tuple("x" * len(names))], names))
    assert classification.columns == ["descritores", "decisao", "texto_integral_sem_decisao"]
    assert "url" in descriptive.columns and "texto_integral_completo" not in descriptive.columns


def dated(spark, days):
    return spark.createDataFrame([(i, f"u{i}", d) for i, d in enumerate(days)], "_row_id int, url string, data_acordao string")


def test_gold_split(spark):
    df = dated(spark, ["01-06-2025", "15/05/2025", "30-04-2025", "01-01-2020", None])
    gold, train = curate.gold_split(df, "dv", 2)
    assert [r.url for r in gold.collect()] == ["u0", "u1"]
    assert {r.url for r in train.collect()} == {"u2", "u3", "u4"}
    assert {r.url for r in curate.gold_split(df, "dv", 2, keep_undated=False)[1].collect()} == {"u2", "u3"}
    assert curate.disjoint(gold, train, "url")
    assert [r.url for r in curate.gold_split(df, "dv", 1)[0].collect()] == ["u0"]
    with pytest.raises(ValueError, match="Not enough cases"):
        curate.gold_split(df, "dv", 5)


def test_attach_text(spark):
    left = spark.createDataFrame([("u1",), ("u2",)], "url string")
    full = spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u3", "c")], "url string, texto_integral_completo string")
    assert {tuple(r) for r in curate.attach_text(left, full).collect()} == {("u1", "a"), ("u2", "b")}
    with pytest.raises(ValueError, match="repeats"):
        curate.attach_text(left, full.union(full))
    with pytest.raises(ValueError, match="no text"):
        curate.attach_text(left, full.where("url <> 'u2'"))
    with pytest.raises(ValueError, match="missing columns"):
        curate.attach_text(left, full.drop("texto_integral_completo"))


def test_update_and_backfill(spark):
    df = spark.createDataFrame([("u1", " ", "Recurso provido."), ("u2", "x", "Recurso negado."), ("u3", None, None)], "url string, decisao string, decisao_extraida_do_texto_integral string")
    got = {r.url: (r.decisao, r.decisao_resumo_extraida) for r in curate.backfill_decisions(df).collect()}
    assert got == {"u1": ("REVOGADA", "REVOGADA"), "u2": ("x", None), "u3": (None, None)}
    new = spark.createDataFrame([("u1", "n"), ("u2", None)], "url string, decisao string")
    assert {r.url: r.decisao for r in curate.update_from(df, new, "url", ["decisao"]).collect()} == {"u1": "n", "u2": "x", "u3": None}


def test_ranks_and_folds(spark):
    df = spark.range(37).select(F.col("id"), (F.col("id") % 5).alias("k"))
    order = [F.col("k").asc_nulls_last(), F.col("id").asc()]
    want = {i: n + 1 for n, i in enumerate(sorted(range(37), key=lambda i: (i % 5, i)))}
    assert {r.id: r._rank for r in curate.global_rank(df, order).collect()} == want
    folds = curate.expanding_folds(df, order, 5).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in folds} == {(i, s): n for i in range(5) for s, n in (("val", 6), ("train", 7 + 6 * i))}


def test_validation(spark):
    df = spark.createDataFrame([("a", " x  y ", "k"), ("b", " ", "k"), ("c", None, "k")], "id string, text string, label string")
    assert [tuple(r) for r in curate.validate_dataset(df, "id", "text", "label").collect()] == [("a", "x y", "k")]
    with pytest.raises(ValueError, match="nulls or repeats"):
        curate.validate_dataset(df.union(df), "id", "text", "label")


def test_epoch_orders_are_shuffles_of_all_rows(spark):
    import hashlib

    df = spark.createDataFrame([(i, "x") for i in range(50)] + [(None, "y"), (7, "z")], "k long, place string").drop("place")
    rows = curate.epoch_order(df, "k", 3, 9).collect()
    for epoch in range(3):
        own = sorted((r for r in rows if r.epoch == epoch), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, 53)) and sorted(r.k for r in own if r.k is not None) == sorted([*range(50), 7])
        marks = [hashlib.md5("|".join(["9", str(epoch)] + ([] if r.k is None else [str(r.k)])).encode()).hexdigest() for r in own]
        assert marks == sorted(marks)
    assert curate.epoch_order(df.limit(0), "k", 2).collect() == []
