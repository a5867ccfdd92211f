import numpy as np
import pytest

from casekit.operators import nearest, retrieve


def clustered(n, dim, centers, seed=0, noise=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, dim))
    x = c[rng.integers(0, centers, n)] + noise * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, cases=("dv", "boc"), ids=None):
    rows = [(None if v is None else [[float(a) for a in v]], ids[i] if ids else i, cases[i % len(cases)], f"k{i % 3}") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vectors array<array<double>>, doc long, case_type string, label string").repartition(5)


def exhaustive(df, queries, n):
    pairs = retrieve.similarities(queries, df, "doc", "case_type", "vectors")
    return {(r.query_id, r.candidate_rank): (r.doc, r.similarity) for r in retrieve.top_candidates(pairs, "doc", n).collect()}


def by_index(df, queries, n, **how):
    index = nearest.build_vector_index(df, "doc", "case_type", "vectors", ("label",), cells=how.pop("cells", None))
    return {(r.query_id, r.candidate_rank): (r.doc, r.similarity) for r in nearest.nearest(index, queries, "doc", "case_type", "vectors", n, **how).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


@pytest.mark.parametrize("kind", ["clustered", "random", "copies"])
def test_exact_search_equals_meeting_every_candidate(spark, kind):
    rng = np.random.default_rng(4)
    x = {"clustered": clustered(1500, 16, 30), "random": rng.normal(size=(600, 12)), "copies": np.repeat(rng.normal(size=(9, 5)), 80, axis=0)}[kind]
    df = frame(spark, x)
    queries = df.where("doc % 20 = 0")
    same(by_index(df, queries, 20), exhaustive(df, queries, 20))


def test_few_pairs_are_made_and_recall_of_probes(spark):
    x = clustered(6000, 16, 60, 1)
    df = frame(spark, x, cases=("dv",))
    index = nearest.build_vector_index(df, "doc", "case_type", "vectors", cells=60)
    queries = df.where("doc % 20 = 0")
    want = exhaustive(df, queries, 20)
    rows = queries.selectExpr("doc as id", "case_type as case", "vectors[0] as direction").collect()
    q = nearest._block(index, rows)
    floors = np.array([want[r["id"], 20][1] for r in rows])
    pairs = nearest._scan(index, index.table, q, 20, floors).where("q = -1").agg({"similarity": "sum"}).first()[0]
    assert pairs < 0.1 * len(rows) * len(x)
    got = {(r.query_id, r.doc) for r in nearest.nearest(index, queries, "doc", "case_type", "vectors", 20, exact=False, probes=2).collect()}
    wanted = {(k[0], v[0]) for k, v in want.items()}
    assert len(got & wanted) >= 0.9 * len(wanted)


def test_blocks_of_queries_ids_and_kept_columns(spark, monkeypatch):
    x = clustered(300, 8, 6, 2)
    df = frame(spark, x)
    queries = df.where("doc % 20 = 0")
    want = exhaustive(df, queries, 5)
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 500)
    same(by_index(df, queries, 5), want)
    named = df.selectExpr("vectors", "concat('d', doc) as doc", "case_type", "label")
    index = nearest.build_vector_index(named, "doc", "case_type", "vectors", ("label",))
    out = nearest.nearest(index, named.where("doc in ('d0', 'd7')"), "doc", "case_type", "vectors", 3)
    assert out.columns == ["doc", "similarity", "direction", "label", "candidate_rank", "query_id"]
    assert all(r.label == f"k{int(r.doc[1:]) % 3}" and r.doc != r.query_id for r in out.collect()) and out.count() == 6
    assert retrieve.diverse(out, "doc", 2, None).count() == 4


def test_nulls_empty_tables_and_unequal_lengths(spark):
    x = list(clustered(40, 4, 3, 3)) + [None, None]
    df = frame(spark, x, ids=[*range(40), 40, None])
    queries = df.where("doc % 4 = 0 or doc is null")
    same(by_index(df, queries, 45), exhaustive(df, queries, 45))
    same(by_index(df, queries, 1, probes=1, cells=40), exhaustive(df, queries, 1))
    assert by_index(df.limit(0), queries, 3) == {} and by_index(df, queries.limit(0), 3) == {}
    odd = df.selectExpr("case when doc % 2 = 0 then array(slice(vectors[0], 1, 2)) else vectors end as vectors", "doc", "case_type", "label")
    with pytest.raises(ValueError, match="entries"):
        nearest.build_vector_index(odd, "doc", "case_type", "vectors")
    with pytest.raises(ValueError, match="n must"):
        by_index(df, queries, 0)


def test_centroids_keep_all_cells():
    x = np.repeat(np.eye(3), 50, axis=0)
    c = nearest.centroids(x, 8)
    assert c.shape == (8, 3) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert nearest.centroids(np.zeros((4, 2)), 3).shape == (1, 2)
