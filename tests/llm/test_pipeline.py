import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casekit.llm import decontam, simhash
from casekit.llm._common import discard, free_name, materialize

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    junk = spark.createDataFrame([(10**6, "--- 123 !!!", "en", "src0", 11), (10**6 + 1, None, None, None, None)], docs.schema)
    docs, kept = docs.unionByName(junk), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, DATA), "test")
        assert out.columns == columns
        kept[name], docs, before = out, out, docs
        if name == "language_id":
            assert {r.doc_id for r in before.join(out, "doc_id", "left_anti").collect()} == {10**6, 10**6 + 1}
        if name == "near_dedup":
            reps = simhash.near_duplicates(before).groupBy("component_id").count().count()
            assert out.count() == reps == out.select("doc_id").distinct().count()
        if name == "decontamination":
            found = decontam.find_contamination(before, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert out.count() == found.where(~decontam.contaminated()).count() < before.count()
        if name == "source_mix":
            words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
            assert abs(words(out) / words(before) - 1) < 0.05 and out.join(before, "doc_id", "left_anti").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.agg(F.max(F.col("start") + F.col("n_tokens")) - F.sum("n_tokens")).first()[0] == 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_tables_in_the_shared_folder(spark):
    df = spark.createDataFrame([(1, "a", None)], "id int, Language string, n int")
    assert free_name(df, "language", "language", "x") == ["language_", "language__", "x"]
    out = materialize(df, "t")
    assert out.collect() == df.collect() and out.schema == df.schema
    discard(out)
    with pytest.raises(Exception):
        spark.read.parquet(out._casekit_path).count()
