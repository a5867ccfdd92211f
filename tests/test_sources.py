import json

import pytest
from pyspark.sql import functions as F

from casekit.operators import curate
from casekit.sources import readers, sinks
from casekit.streaming import ingest

RECORD = {"url": "u", "tribunal": "TRP", "n_processo": "1/20", "texto_integral_disponivel": "S", "decisao": None, "descritores": ["a", "b"], "decisao_extraida_do_texto_integral": "Recurso provido.", "metadata_decisao": {"confidence": "high", "requires_manual_review": False}, "campos_especificos": {}}


@pytest.fixture
def raw(tmp_path):
    for name, n in (("b_violencia_domestica_trp.json", 2), ("a_violencia_domestica_trl.json", 3), ("x_incumprimento_contratos.json", 1)):
        (tmp_path / name).write_text(json.dumps([RECORD | {"url": f"{name}{i}", "n_processo": f"{i}/20"} for i in range(n)]))
    return tmp_path


def test_raw_records(spark, raw):
    df = readers.read_raw(spark, str(raw), "dv")
    rows = df.orderBy("_row_id").collect()
    assert [r.url for r in rows] == [f"{f}{i}" for f, n in (("a_violencia_domestica_trl.json", 3), ("b_violencia_domestica_trp.json", 2)) for i in range(n)]
    assert rows[0].metadata_decisao_confidence == "high" and rows[0].descritores == ["a", "b"]
    assert {r.n for r in readers.file_counts(df).collect()} == {2, 3}
    clean = curate.curate(df)
    assert [(r.n_processo, r.decisao) for r in clean.orderBy("n_processo").collect()] == [(f"{i}/20", "REVOGADA") for i in range(3)]
    assert "texto_integral_completo" not in curate.views(clean)[1].columns
    with pytest.raises(ValueError, match="no files"):
        readers.read_raw(spark, str(raw / ".."), "boc")


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x"\nnew', [1.0, float("nan")]), (2, None, None)], "id int, t string, v array<double>")
    sinks.write_csv(df, f"{tmp_path}/a.csv")
    back = readers.read_table(spark, f"{tmp_path}/a.csv", ["id", "t"])
    assert {tuple(r) for r in back.collect()} == {("1", 'say "x"\nnew'), ("2", None)}
    (path,) = sinks.write_table_json(df.drop("v").coalesce(1), f"{tmp_path}/t", "gold")
    got = json.loads(open(path.removeprefix("file:"), encoding="utf-8").read())
    assert got == {"schema": {"fields": [{"name": "id", "type": "integer"}, {"name": "t", "type": "string"}]}, "data": [{"id": 1, "t": 'say "x"\nnew'}, {"id": 2, "t": None}]}
    assert sorted(map(tuple, sinks.read_table_json(spark, f"{tmp_path}/t").collect())) == [(1, 'say "x"\nnew'), (2, None)]
    (path,) = sinks.write_json_array(df.drop("v").coalesce(1), f"{tmp_path}/arrays", "raw")
    assert json.loads(open(path.removeprefix("file:"), encoding="utf-8").read()) == got["data"]
    assert sinks.write_json_array(df.limit(0), f"{tmp_path}/arrays", "none") == []
    sinks.write_parquet(df, f"{tmp_path}/p.parquet", ["id"])
    assert readers.read_table(spark, f"{tmp_path}/p.parquet").count() == 2
    flat = spark.createDataFrame([(1, float("nan"))], "id int, x double")
    assert sinks.nested_json(flat, "id").first().json == '{"id":1,"x":null}'
    assert readers.first_path(spark, [f"{tmp_path}/none", f"{tmp_path}/t"]) == f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        readers.first_path(spark, [f"{tmp_path}/none"])
    with pytest.raises(ValueError, match="unknown format"):
        readers.read_table(spark, "x.xml")
    sinks.write_reports(spark.createDataFrame([("a b", "<p>")], "c string, h string"), f"{tmp_path}/r", "c", "h")
    assert spark.read.text(f"{tmp_path}/r").first().report == "a_b"


def test_resume(spark, tmp_path):
    path = f"{tmp_path}/done"
    seen = []

    def work(df):
        seen.append(df.count())
        return df.withColumn("y", F.col("id") * 2)

    assert sinks.resume(spark.range(10), path, "id", work, every=4) == 3
    assert sinks.resume(spark.range(15), path, "id", work) == 1 and seen[-1] == 5
    assert sinks.resume(spark.range(15), path, "id", work) == 0
    assert spark.read.parquet(path).count() == 15


def test_stream_adds_once(spark, raw, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("added")
    path, mark = f"{tmp_path}/table", f"{tmp_path}/mark"

    def run():
        stream = ingest.raw_stream(spark, str(raw), "dv")
        ingest.add_new(stream, path, mark, "url").awaitTermination()

    run()
    assert spark.read.parquet(path).count() == 5
    (raw / "c_violencia_domestica.json").write_text(json.dumps([RECORD | {"url": "new"}, RECORD | {"url": "a_violencia_domestica_trl.json0"}]))
    run()
    assert spark.read.parquet(path).count() == 6
    # The last batch is run again, as after a failure before it was marked as done.
    commits = sorted((tmp_path / "mark" / "stream" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert spark.read.parquet(path).count() == 6
    # Another run, whose state knows nothing, adds no key that is there.
    (raw / "d_violencia_domestica.json").write_text(json.dumps([RECORD | {"url": "newer"}]))
    mark = f"{tmp_path}/other"
    run()
    found = spark.read.parquet(path)
    assert found.count() == 7 == found.select("url").distinct().count()
    spark.range(3).write.parquet(f"{tmp_path}/foreign")
    with pytest.raises(ValueError):
        ingest.add_new(ingest.raw_stream(spark, str(raw), "dv"), f"{tmp_path}/foreign", f"{tmp_path}/third", "url")


def test_case_type_of_names(spark):
    df = spark.createDataFrame([("x/dv_gold.parquet",), ("/a/pred_ic_run.csv",), ("boc.csv",), ("q",)], "p string")
    assert [r[0] for r in df.select(readers.case_type_of(F.col("p"))).collect()] == ["dv", "boc", "boc", None]


def test_portions_of_resume_are_bounded(spark, tmp_path):
    path, seen = f"{tmp_path}/many", []

    def work(df):
        seen.append(1)
        return df.withColumn("y", F.col("id") * 2)

    assert sinks.resume(spark.range(200), path, "id", work, every=2) == len(seen) <= 16
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(i, 2 * i) for i in range(200)]
