import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.llm import passages


def by_hand(texts, least):
    where, split = defaultdict(set), [(t or "").encode().split() for t in texts]
    for i, w in enumerate(split):
        for j in range(len(w) - least + 1):
            where[tuple(w[j : j + least])].add(i)
    out = []
    for w in split:
        hit = np.zeros(len(w) + 2, int)
        for j in range(len(w) - least + 1):
            if len(where[tuple(w[j : j + least])]) > 1:
                hit[j + 1 : j + least + 1] = 1
        out.append(np.flatnonzero(np.diff(hit)).tolist())
    return out


def make(seed, n=60, least=12):
    """Texts over few words that share passages around the least length, in many mixtures."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6 if seed % 2 else 400)]
    shared = [rng.choices(vocab, k=rng.randint(least - 3, 3 * least)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(1, 4)):
            t += rng.choices(vocab, k=rng.randint(0, 2 * least))
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            t += s[a : a + rng.randint(least // 2, 3 * least)]
        texts.append(rng.choice((" ", "\n", "\t ")).join(t))
    return texts + [None, "", "short", texts[0], "a b " * 400]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    texts = make(seed)
    df = spark.createDataFrame([(t, i, 0) for i, t in enumerate(texts)], "text string, doc_id long, mark int")
    got = {r.doc_id: (r.n_repeated, list(r.spans)) for r in passages.repeated_passages(df, least=12, gram=4).collect()}
    want = {i: (sum(s[1::2]) - sum(s[::2]), s) for i, s in enumerate(by_hand(texts, 12)) if s}
    assert got == want


def test_default_length(spark):
    rng = random.Random(9)
    word = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    p49, p50, p90 = word(49), word(50), word(90)
    texts = [word(70) + p + word(3) for p in (p49, p49, p50, p50, p90, p90)] + [word(500), word(60) + p90[:55], p90[30:] + word(9)]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.spans) for r in passages.repeated_passages(df).collect()}
    assert got == {i: s for i, s in enumerate(by_hand(texts, 50)) if s} and set(got) == {2, 3, 4, 5, 7, 8}


def test_repeated_rows_and_odd_ids(spark):
    text = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text + " more words"), (3, None)], "doc_id long, text string")
    got = passages.repeated_passages(df).select("doc_id", F.array_join("spans", ",").alias("s")).collect()
    assert sorted((r.doc_id or -1, r.s) for r in got) == [(-1, "0,60"), (1, "0,60"), (1, "0,60"), (2, "0,60")]
    assert passages.repeated_passages(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, (text + " ") * 3)], "doc_id long, text string")
    assert passages.repeated_passages(alone).count() == 0


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(1)
    inner = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    found = []
    for left, right in ((0, 0), (30, 5), (7, 100)):
        words = np.concatenate([rng.integers(0, 1 << 62, left), inner, rng.integers(0, 1 << 62, right)]).astype(np.uint64)
        at, grams, _ = passages.anchors(words)
        found.append({(p - left, g) for p, g in zip(at.tolist(), grams.tolist()) if left <= p <= left + 42})
    assert set.intersection(*found)


def test_runs_over_many_partitions(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(14))
    texts = ["a b " * 300 + passage, passage + " a b" * 200, "c " * 500, "c " * 30 + " ".join(rng.choices("defgh", k=40)), "a b " * 300 + "z " + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = {r.doc_id: list(r.spans) for r in passages.repeated_passages(df, least=12, gram=4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: s for i, s in enumerate(by_hand(texts, 12)) if s}
