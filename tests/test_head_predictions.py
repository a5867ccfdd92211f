import os

import pytest

from casekit.plans import vector_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_vector_is_scored(spark):
    out = vector_queries.head_predictions(spark, DATA).collect()
    assert len(out) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert all(r.held_out == (r.vec_id % 5 == 0) and r.y_pred is not None for r in out)
