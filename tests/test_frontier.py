import time

from pyspark.errors import AnalysisException

from casekit.streaming import frontier as f


def stream(spark, folder, at_once=1):
    return spark.readStream.schema("href string").option("maxFilesPerTrigger", at_once).json(str(folder))


def put(folder, name, links):
    import json

    (folder / f"{name}.json").write_text("\n".join(json.dumps({"href": h}) for h in links))


def test_each_link_leaves_once_over_batches_and_restarts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    put(src, "a", ["http://A.x/1", "http://a.x/2", "http://a.x/2", "http://b.x/1", None, "mailto:q"])
    put(src, "b", ["http://a.x/2", "http://a.x/3", "http://b.x/1"])
    f.run_frontier(stream(spark, src), out, mark).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.host, r.href) for r in rows) == [("", "mailto:q"), ("a.x", "http://A.x/1"), ("a.x", "http://a.x/2"), ("a.x", "http://a.x/3"), ("b.x", "http://b.x/1")]
    assert sorted(r.place for r in rows if r.host == "a.x") == [0, 1, 2]
    put(src, "c", ["http://a.x/1", "http://a.x/3", "http://b.x/2"])
    query = f.run_frontier(stream(spark, src), out, mark)
    query.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 7 and {r.href for r in rows} >= {"http://a.x/1", "http://b.x/2"} and {r.place for r in rows if r.host == "a.x"} == {0, 1, 2, 3}
    # A batch reads its own links: three rows came in, whatever is in the state.
    assert sum(p["numInputRows"] for p in query.recentProgress) == 3
    f.run_frontier(stream(spark, src), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def test_a_host_keeps_its_pace(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "a", [f"http://a.x/{i}" for i in range(3)] + ["http://b.x/0"])
    out = str(tmp_path / "out")
    began, left = time.time(), {}
    query = f.run_frontier(stream(spark, src), out, str(tmp_path / "mark"), pace=2.0, once=False)
    try:
        while time.time() - began < 90 and len(left) < 4:
            time.sleep(0.2)
            try:
                for r in spark.read.schema(f.OUT).parquet(out).collect():
                    left.setdefault((r.host, r.place), time.time())
            except AnalysisException:  # the folder isn't there yet
                pass
    finally:
        query.stop()
    assert sorted(left) == [("a.x", 0), ("a.x", 1), ("a.x", 2), ("b.x", 0)]
    assert left["a.x", 2] - left["a.x", 0] > 1.9
