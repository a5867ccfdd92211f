import random
import zlib

import pytest
from pyspark.sql import functions as F

from casekit.llm import langid

VOCAB = {"en": "the of and with house water that time under".split(), "de": "der und mit haus wasser nicht zeit unter über".split(), "fr": "le et avec maison eau pas temps sous où".split()}


def make(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOCAB))
        rows.append((i, " ".join("".join(rng.sample(w, len(w))) if rng.random() < 0.1 else w for w in rng.choices(VOCAB[lang], k=rng.randint(5, 60))), lang))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = make(600)
    return langid.train([r[1] for r in rows], [r[2] for r in rows], epochs=4)


def test_accuracy_and_calibration(spark, model):
    rows = make(300, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, language string")
    got = langid.identify(df, model, out_col="p").collect()
    assert sum(r.p.lang == r.language for r in got) >= 297
    assert all(0 <= r.p.score <= 1 for r in got) and sum(r.p.rejected for r in got) <= 2
    assert 0.05 < model.threshold < 0.99


def test_odd_texts(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- !?"), (4, "the " * 50000), (5, "Ж漢字")], "doc_id long, text string")
    got = {r.doc_id: r.p for r in langid.identify(df, model, out_col="p").collect()}
    assert [(got[i].lang, got[i].score, got[i].rejected) for i in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert got[4].lang == "en" and not got[4].rejected and got[5].lang in VOCAB
    empty = langid.train([], [])
    assert langid.identify(df, empty, out_col="p").first().p.lang == "und"


def test_a_full_cache_changes_nothing(model):
    import numpy as np

    weights = model.folded()
    texts = [r[1] for r in make(40, 3)] + [None, "!"]
    a = list(langid._logits(texts, weights, ({}, [np.zeros((4, 4))])))
    b = list(langid._logits(texts, weights, ({}, [np.zeros((4, 4))]), most=3))
    assert all(x is y is None or np.allclose(x, y) for x, y in zip(a, b))


def test_training_rows(spark):
    rows = [*make(400), (None, "x y", "en"), (401, None, "en"), (402, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items() if i is not None) and held[None] is False
    texts = {r.text for r in langid.training_rows(df).collect()}
    assert texts == {t for i, t, lang in rows if i is not None and t and lang and not held[i]}
    some = langid.training_rows(df, bound=60).groupBy("lang").count().collect()
    assert all(5 <= r["count"] <= 40 for r in some)
    assert langid.fit(df.limit(0)).langs == []
