import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.sources import progress as p


def test_filters_hold_all_and_few_others():
    rng = np.random.default_rng(0)
    mine, others = (rng.integers(-(2**63), 2**63 - 1, 20000) for _ in range(2))
    size, bits = p.bloom(mine)
    assert len(bits) == size // 8 and p.may_hold(mine, size, bits).all() and p.may_hold(others, size, bits).mean() < 0.01
    assert not p.may_hold(others, *p.bloom(mine[:0])).any()


def double(df):
    return df.withColumn("y", F.col("id") * 2)


def done(log):
    out = log.read()
    return [] if out is None else sorted((r.id, r.y) for r in out.select("id", "y").collect())


def test_runs_add_what_is_not_done(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(p, "BUCKET_KEYS", 100)
    log = p.ProgressLog(spark, str(tmp_path / "log"), "id")
    assert log.run(spark.range(1000), double, every=300) == 4 and done(log) == [(i, 2 * i) for i in range(1000)]
    assert log.run(spark.range(1000), double) == 0 and log.run(spark.range(500, 1200), double) == 1
    assert done(log) == [(i, 2 * i) for i in range(1200)]
    # New keys alone: filters rule the parts out, so nearly no folder of the 10 buckets and 5 parts is read.
    log.read_folders = 0
    assert log.left(spark.range(5000, 5100), log._buckets(0)).count() == 100 and log.read_folders <= 10
    nulls = spark.createDataFrame([(None,), (7,), (3000,), (3000,)], "id long")
    assert log.run(nulls, double) == 1 and len(done(log)) == 1202
    assert log.run(spark.range(0), double) == 0


def test_portions_do_not_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(p, "MOST_PORTIONS", 3)
    log = p.ProgressLog(spark, str(tmp_path / "log"), "id")
    assert log.run(spark.range(2000), double, every=3) == 3 and len(done(log)) == 2000


@pytest.mark.parametrize("step", ["work", "part", "entry", "after"])
def test_a_run_killed_at_any_step_leaves_each_key_once(spark, tmp_path, monkeypatch, step):
    log = p.ProgressLog(spark, str(tmp_path / "log"), "id")
    calls, real = [], p.ProgressLog._add

    def killed(self, results, buckets):
        calls.append(1)
        if len(calls) != 2:
            return real(self, results, buckets)
        if step == "work":
            raise RuntimeError("killed")
        if step == "part":  # half of a part, without its end
            real_results = results.where("id % 2 = 0")
            self._keyed(real_results, buckets).drop("_h").write.partitionBy("_bucket").parquet(f"{self.path}/parts/halfway")
            raise RuntimeError("killed")
        if step == "entry":  # a whole part, but no entry
            self._keyed(results, buckets).drop("_h").write.partitionBy("_bucket").parquet(f"{self.path}/parts/whole")
            raise RuntimeError("killed")
        real(self, results, buckets)
        raise RuntimeError("killed")

    monkeypatch.setattr(p.ProgressLog, "_add", killed)
    with pytest.raises(RuntimeError):
        log.run(spark.range(300), double, every=100)
    monkeypatch.setattr(p.ProgressLog, "_add", real)
    before = len(done(log))
    assert 0 < before < 300
    log.run(spark.range(300), double, every=100)
    assert done(log) == [(i, 2 * i) for i in range(300)]
    assert log.clean() == (1 if step in ("part", "entry") else 0) and log.clean() == 0 and len(done(log)) == 300


def test_text_keys_and_an_empty_log(spark, tmp_path):
    log = p.ProgressLog(spark, str(tmp_path / "log"), "k")
    assert log.read() is None and log.clean() == 0
    df = spark.createDataFrame([("a/1",), ("é",), ("",)], "k string")
    assert log.run(df, lambda d: d.withColumn("n", F.length("k"))) == 1 and log.run(df, lambda d: d.withColumn("n", F.lit(0))) == 0
    assert sorted(map(tuple, log.read().select("k", "n").collect())) == [("", 0), ("a/1", 3), ("é", 1)]
