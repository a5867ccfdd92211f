import math
import random
import re
from collections import Counter

import pytest

from casekit.llm import lexical as x

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def exhaustive(docs, items, k=10):
    """(item, rank, id, score) by scoring every document for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    common, rare = ["the", "Of", "és", "and", "x1"], [f"w{i}" for i in range(800)]
    marks = [" ", ", ", "-", "\n", "'", "_", "…", "   "]
    make = lambda k: "".join(rng.choice(common if rng.random() < 0.5 else rare) + rng.choice(marks) for _ in range(k))
    docs = [(i, make(rng.choice((0, 1, 5, 40, 200)))) for i in range(n)]
    return docs, [(j, make(rng.randint(0, 30))) for j in range(25)]


def found(spark, docs, items, parts=3, **how):
    d = spark.createDataFrame([(t, i, "clash") for i, t in docs], "text string, doc_id long, terms string").repartition(parts)
    q = spark.createDataFrame([(t, i) for i, t in items], "text string, item_id long")
    index = x.build_index(d)
    out = x.search(index, q, **how).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in out), key=str)


def test_against_scoring_everything(spark):
    docs, items = corpus(700, 1)
    items += [(100, docs[17][1] or "w1"), (101, None), (102, "..."), (103, "unheardof"), (104, "the THE the w3 w3")]
    assert found(spark, docs, items) == exhaustive(docs, items)
    assert found(spark, docs, items[:9], parts=1, k=3) == exhaustive(docs, items[:9], 3)


def test_groups_of_queries_give_what_one_gives(spark, monkeypatch):
    docs, items = corpus(300, 2)
    monkeypatch.setattr(x, "GROUP_TERMS", 60)
    assert found(spark, docs, items) == exhaustive(docs, items)


def test_ties_copies_nulls_and_repeats(spark):
    docs = [(i, "same words here") for i in range(500, 200, -1)] + [(None, "same words here"), (7, None), (8, ""), (250, "same words here"), (9, "other text")]
    items = [(1, "words"), (1, "words"), (None, "same other")]
    got = found(spark, docs, items, parts=7)
    assert got == exhaustive(docs, items)
    assert [r[2] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[1])][:4] == [None, None, 201, 201]


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert found(spark, [], items, 1) == found(spark, docs, [], 1) == found(spark, [(1, None), (2, "..")], items, 1) == []
    assert found(spark, docs, items, 1) == exhaustive(docs, items)


def test_long_texts_and_very_long_items(spark):
    docs = [(1, " ".join(f"w{i % 5000}" for i in range(200000))), (2, "w1 " * 70000), (3, "w1 w2")] + [(10 + i, f"w{i} filler") for i in range(100)]
    items = [(1, "w1"), (2, " ".join(f"w{i}" for i in range(5000)))]
    assert found(spark, docs, items, 2) == exhaustive(docs, items)


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    docs = [(i, "common " + ("needle " if i in (5, 6) else "") + f"hay{i}") for i in range(64 * 20)]
    scored = []
    real = x._Scorer.scores
    monkeypatch.setattr(x._Scorer, "scores", lambda self, *a: scored.append(self.row["block"]) or real(self, *a))
    index = x.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    batches = index.blocks(spark).toArrow().to_batches()
    queries = x._group([{"q": 0, "terms": ["common", "needle"]}])
    import numpy as np

    weights = np.array([x.weight(1280, 1280), x.weight(1280, 2)], np.int64)
    rows = [r for b in x._top_documents(queries, weights, np.zeros(1, np.int64), 2)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["id"] for r in rows) == [5, 6] and len(scored) == 1 and sum(b.num_rows for b in batches) == 20


@pytest.mark.parametrize("data", [b"", "A-b_Ç…9\x7fé ß!z".encode()])
def test_terms(data):
    assert [t.decode() for t in x.terms_of(data)] == terms(data.decode()) and x.terms_of(None) == []
