import hashlib
import random
import re

from casekit.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, size=13):
    out = []
    for _, text in docs:
        w = words(text)
        hit, named = set(), set()
        for item, t in items:
            v = words(t)
            n = min(size, len(v))
            for k in range(len(v) - n + 1) if v else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[k : k + n]:
                        hit.update(range(i, i + n))
                        named.add(item)
        out.append((len(w), len(hit), sorted(x for x in named if x is not None)))
    return out


def make():
    rng = random.Random(5)
    vocab = ["the", "of", "Éa", "x1", "And", "zu", "naïve", "q"]
    items = [(str(i), " ".join(rng.choices(vocab, k=rng.randint(14, 30)))) for i in range(8)]
    items += [("short", "only Three words"), ("one", "unique"), ("none", "... !"), ("nil", None), (None, "null id item words here"), ("0", "twice the same id but other words")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, "Only, three WORDS; unique"), (5, "null id item words here")]
    for i in range(30):
        t = rng.choices(vocab, k=rng.randint(5, 60))
        if i % 2:
            v = rng.choice(items[:8])[1].split(" ")
            a = rng.randint(0, len(v) - 1)
            t[3:3] = v[a : a + rng.randint(10, 20)]
        docs.append((6 + i, rng.choice((" ", ", ", "\n")).join(t)))
    docs.append((99, items[0][1] + " " + "filler " * 3000 + items[1][1]))
    docs.append((99, items[0][1] + " " + "filler " * 3000 + items[1][1]))
    return docs, items


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(t, i, "c") for i, t in docs], "text string, doc_id long, n_words string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.find_contamination(d, b, **how).collect()
    return sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"]), list(r.spans)) for r in got)


def test_against_brute_force(spark):
    docs, items = make()
    want = sorted((i, *x) for (i, _), x in zip(docs, by_hand(docs, items)))
    got = run(spark, docs, items)
    assert [r[:4] for r in got] == want
    assert all(sum(s[1::2]) - sum(s[::2]) == n for _, _, n, _, s in got)


def test_blocks_give_the_same(spark):
    docs, items = make()
    assert run(spark, docs, items, index_bytes=400) == run(spark, docs, items)


def test_nothing_to_find(spark):
    assert [r[1:4] for r in run(spark, [(1, "a b")], [])] == [(2, 0, [])]
    assert run(spark, [], [("a", "b")]) == []
    kept = decontam.find_contamination(spark.createDataFrame([(1, "a b", 2)], "doc_id int, text string, k0 int"), spark.createDataFrame([("i", "a b")], "item_id string, text string"), keep=("doc_id", "text", "k0"))
    row = kept.withColumn("bad", decontam.contaminated()).first()
    assert (row.doc_id, row.text, row.k0, row.n_hit, row.bad) == (1, "a b", 2, 2, True)


def test_rule(spark):
    df = spark.createDataFrame([(0, 10), (1, 20), (1, 21), (0, 0)], "n_hit long, n_words long")
    assert [r[0] for r in df.select(decontam.contaminated()).collect()] == [False, True, False, False]
    assert decontam.digest(["b", "a"]) == hashlib.sha256(b"a,b").hexdigest()
