"""Scores of sentences to the last bit, as the SQL gives them."""

import pytest
from pyspark.sql import functions as F

from casekit.operators import sentences

QUERY = [73.8, 8.2, 6.6, 10.2]
#: Counts that point the same way, as those of real sentences do, and some whose cosines depend on roundings.
VECTORS = [[39.0, 6.0, 3.0, 6.0], [26.0, 4.0, 2.0, 4.0], [27.0, 0.0, 6.0, 3.0], [9.0, 0.0, 2.0, 1.0], [55.0, 0.0, 1.0, 5.0], [27.0, 5.0, 2.0, 5.0], [13.0, 5.0, 5.0, 0.0], [13.0, 3.0, 4.0, 5.0]]


def test_cosines_equal_those_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    many = [VECTORS[: k + 1] for k in range(len(VECTORS))]
    df = spark.createDataFrame(list(enumerate(many)), "id int, vectors array<array<float>>").withColumn("sentences", F.transform("vectors", lambda _: F.lit("x")))
    out = sentences.with_scores(df, QUERY, weights=(1, 1, 0)).orderBy("id").collect()
    norm = lambda x: f"greatest(sqrt(list_dot_product({x}, {x})), 1e-9)"
    for row in out:
        c = [sum(x) / len(x) for x in zip(*many[row.id], strict=True)]
        for v, score in zip(many[row.id], row.scores, strict=True):
            sql = f"select 0.5::double * (list_dot_product(v, q) / ({norm('v')} * {norm('q')})) + 0.5::double * (list_dot_product(v, c) / ({norm('v')} * {norm('c')})) from (select ?::double[] as v, ?::double[] as q, ?::double[] as c)"
            assert duckdb.execute(sql, [v, QUERY, c]).fetchone()[0] == score


def test_nulls_have_no_scores(spark):
    df = spark.createDataFrame([(1, None, None), (2, [], []), (3, ["a", "b"], [[1.0, 0.0], None])], "id int, sentences array<string>, vectors array<array<float>>")
    got = {r.id: r.query for r in df.select("id", sentences.fused_cosines(F.col("vectors"), [1.0, 0.0]).alias("n")).select("id", "n.query").collect()}
    assert got == {1: None, 2: [], 3: [1.0, None]}
