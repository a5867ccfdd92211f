import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.operators import lexicon as x
from casekit.operators.sentences import encoded, hash_encoder


def corpus(n=400, seed=0):
    """Texts of two sentences on one of eight topics; each draws a few of the topic's many words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        topic = int(rng.integers(8))
        make = lambda: " ".join([f"t{topic}w{k}" for k in rng.choice(40, 5, replace=False)] + [f"c{k}" for k in rng.choice(12, 3)])  # noqa: B023, E731
        rows.append((i, topic, make(), make()))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, topic int, first string, second string").repartition(3)


def by_hand(texts, known, near):
    place, v = {w: i for i, w in enumerate(known)}, len(known)
    c = np.zeros((v, v))
    for t in texts:
        ids = [place.get(w, -1) for w in t.split()]
        for i, a in enumerate(ids):
            for j in range(max(0, i - near), min(len(ids), i + near + 1)):
                if i != j and a >= 0 and ids[j] >= 0:
                    c[a, ids[j]] += 1
    return c


def test_counts_information_and_singular_values(spark, monkeypatch):
    texts = ["a b c a a", "b", "", "c c d e f g a b", "x a y b"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(2)
    known = ["a", "b", "c", "d", "g"]
    want = by_hand(texts, known, 3)
    rows = x.near_counts(df, F.col("t"), known, 3).collect()
    got = np.zeros((5, 5))
    for r in rows:
        got[r.i, r.j] = r.c
    assert np.array_equal(got, want) and len(rows) == (want > 0).sum()
    s = want.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.nan_to_num(np.maximum(np.log(want * s.sum() / np.outer(s, s)), 0), neginf=0)
    matrix = x.information(x.near_counts(df, F.col("t"), known, 3)).repartition(3)
    dense = np.zeros((5, 5))
    for r in matrix.collect():
        dense[r.i, r.j] = r.v
    assert np.allclose(dense, m)
    values, left = x.leading(matrix, 5, 5)
    u, exact, _ = np.linalg.svd(m)
    assert np.allclose(values, exact, atol=1e-9)
    assert all(np.linalg.norm(m.T @ left[:, k]) == pytest.approx(exact[k], abs=1e-9) for k in range(5))


def test_leading_values_of_a_larger_matrix(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(120, 120)) * (rng.random((120, 120)) < 0.1)
    b = rng.normal(size=(120, 6)) * 3
    m = a + a.T + b @ b.T
    i, j = np.nonzero(m)
    df = spark.createDataFrame([(int(p), int(q), float(m[p, q])) for p, q in zip(i, j)], "i int, j int, v double").repartition(5, "i")
    values, _ = x.leading(df, 120, 6)
    assert np.allclose(values, np.linalg.svd(m, compute_uv=False)[:6], rtol=1e-6)


def test_nearest_sentences_beat_the_hash(spark, tmp_path):
    rows = corpus()
    df = frame(spark, rows)
    lex = x.fit_lexicon(df.select(F.concat_ws(" ", "first", "second").alias("t")).where("id < 300"), "t", dim=24)
    held = [r for r in rows if r[0] >= 300]

    def right(encode):
        a, b = encode([r[2] for r in held]), encode([r[3] for r in held])
        return np.mean([held[i][1] == held[int(j)][1] for i, j in enumerate((a @ b.T).argmax(axis=1))])

    learned, hashed = right(x.lexicon_encoder(lex)()), right(hash_encoder(24))
    assert learned > 0.9 and learned > hashed + 0.2
    x.save_lexicon(spark, lex, str(tmp_path / "l"))
    back = x.load_lexicon(spark, str(tmp_path / "l"))
    assert back.words == lex.words and np.array_equal(back.vectors, lex.vectors) and np.array_equal(back.shares, lex.shares) and np.array_equal(back.values, lex.values)
    out = df.limit(5).select("first", encoded(F.col("first"), x.lexicon_encoder(lex)).alias("v")).collect()
    assert all(np.allclose(r.v, x.lexicon_encoder(lex)()([r["first"]])[0], atol=1e-6) for r in out)


def test_empty_corpora_and_unknown_texts(spark, tmp_path):
    none = x.fit_lexicon(spark.createDataFrame([(None,), ("",)], "t string"), "t", dim=4)
    assert none.words == () and x.lexicon_encoder(none)()(["a", ""]).tolist() == [[0.0] * 4] * 2
    x.save_lexicon(spark, none, str(tmp_path / "n"))
    assert x.load_lexicon(spark, str(tmp_path / "n")).vectors.shape == (0, 4)
    one = x.fit_lexicon(spark.createDataFrame([("b a b",)] * 5, "t string"), "t", dim=4)
    assert one.words == ("b", "a") and one.vectors.shape == (2, 4)


def test_counts_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    known = [f"w{i}" for i in range(30)]
    texts = [[known[k] for k in rng.integers(0, 30, 50)] for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    place = {w: i for i, w in enumerate(known)}
    total = lambda: {(a, b): n for a, b, n in sum_rows(x._pairs(place, 4)(iter([batch])))}

    def sum_rows(batches):
        out = {}
        for r in batches:
            for a, b, n in zip(*[c.to_pylist() for c in r.columns]):
                out[a, b] = out.get((a, b), 0) + n
        return [(a, b, n) for (a, b), n in out.items()]

    want = total()
    monkeypatch.setattr(x, "_HELD", 100)
    assert total() == want and len(list(x._pairs(place, 4)(iter([batch])))) > 1


def test_words_of_two_texts_are_not_near():
    """Texts are counted many at a time; nulls and empty lists between them count nothing."""
    import pyarrow as pa

    texts = ["a b c a a", "b", "", "c c d e f g a b", "x a y b"]
    known = ["a", "b", "c", "d", "g"]
    lists = [texts[0].split(), None, [], *[t.split() for t in texts[1:]], None]
    got = np.zeros((5, 5))
    for out in x._pairs({w: i for i, w in enumerate(known)}, 3)(iter([pa.record_batch([pa.array(lists, pa.list_(pa.string()))], ["t"])])):
        for i, j, c in zip(*(col.to_pylist() for col in out.columns), strict=True):
            got[i, j] += c
    assert np.array_equal(got, by_hand(texts, known, 3))
