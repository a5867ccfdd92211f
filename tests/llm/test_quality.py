import random
import re
from collections import Counter

from pyspark.sql import functions as F

from casekit.llm import quality as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def by_hand(text):
    """Base statistics of one text, by definition."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in q.SYMBOLS), len(lines) - len(set(lines)), len(hit)


def verdicts(text):
    """The rules that reject a text, by definition."""
    text = text or ""
    n, chars, symbols, dups, again = by_hand(text)
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    letters = [c for c in text if c.isalpha()]
    tests = {
        "few_words": n < 20,
        "repeated_windows": 100 * again > 30 * n,
        "symbols": 10 * symbols > n,
        "word_length": chars < 3 * n or chars > 10 * n,
        "repeated_lines": 2 * dups > len(lines),
        "capitals": 2 * sum(c.isupper() for c in letters) > len(letters),
        "few_letters": 10 * sum(any(c.isalpha() for c in w) for w in words) < 8 * n,
        "bullets": 10 * sum(bool(re.match("[\x20\x09-\x0d]*[-*•‣]", x)) for x in lines) > 9 * len(lines),
        "ellipses": 10 * sum(bool(re.search("(?:\\.\\.\\.|…)[\x20\x09-\x0d]*$", x)) for x in lines) > 3 * len(lines),
    }
    return {k for k, v in tests.items() if v}


def texts(n, seed=5):
    rng = random.Random(seed)
    bits = ["the", "of", "court", "Ärger", "DAS", "été", "&&&", "#", "|", "12", "3.5", "…", "...", "- a", "\n", "\n", "\n- x", " ", "\t", "\x0b", " ", "😀", "a b c d e f g h", "w1 w2 w3 w4 w5 w6 w7 w8 w9"]
    return [" ".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(n)]


def test_statistics_and_verdicts_against_python(spark):
    rows = [None, "", " \n ", "x " * 40, "a b c d e f g h " * 3, "l\n" * 30, "good words make a text " * 1 + " ".join(f"word{i}" for i in range(40))] + texts(400)
    df = spark.createDataFrame([(t, i, "c") for i, t in enumerate(rows)], "text string, doc_id long, n_words string")
    got = {r.doc_id: r for r in q.judge(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert tuple(got[i][k] for k in q.BASE) == by_hand(t), t
        bad = verdicts(t)
        assert got[i].base_failed == bool(bad & set(q.BASE_RULES)) and got[i].kept == (not bad), (t, bad)
    assert got[6].kept


def test_order_changes_no_verdict_and_names_the_first_rule(spark):
    rows = texts(120, 9)
    df = spark.createDataFrame([(t, i) for i, t in enumerate(rows)], "text string, doc_id long").coalesce(1)
    for order in (list(q.RULES), list(reversed(q.RULES))):
        first = {r.doc_id: r.rule for r in df.select("doc_id", q.cascade(F.col("text"), order).alias("rule")).collect()}
        for i, t in enumerate(rows):
            bad = verdicts(t)
            assert first[i] == next((r for r in order if r in bad), None)
    kept = {r.doc_id for r in q.filter_quality(df).collect()}
    assert kept == {i for i, t in enumerate(rows) if not verdicts(t)}


def test_rules_by_rejections_per_cost():
    masks = {0b000: 50, 0b001: 30, 0b011: 10, 0b110: 6, 0b100: 4}  # a rejects 40, b 16, c 10
    out = q.order_rules(masks, {"a": 10.0, "b": 1.0, "c": 1.0})
    # b: 16 a second; then of 84 left c rejects 4 a second against a's 3
    assert [e.rule for e in out] == ["b", "c", "a"]
    assert [round(e.rejects, 4) for e in out] == [0.16, round(4 / 84, 4), round(30 / 80, 4)]
    assert [e.rule for e in q.order_rules({}, {"z": 1.0, "y": 1.0, "x": 0.5})] == ["x", "y", "z"]


def test_estimate_ranks_a_cheap_strict_rule_first(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else " ".join(f"word{i}_{j}" for j in range(300))) for i in range(400)], "doc_id long, text string")
    slow = lambda s: F.exists(F.sequence(F.lit(1), F.lit(20000)), lambda i: F.sqrt(i.cast("double")) < 0) & (s["n_words"] < 0)
    out = q.estimate(df, {"slow": slow, "few_words": q.RULES["few_words"]})
    assert [e.rule for e in out] == ["few_words", "slow"] and out[0].rejects == 0.5 and out[1].cost > out[0].cost


def test_empty_tables_repeats_nulls_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    df = spark.createDataFrame([(None, long), (1, long + " " + long), (1, long + " " + long), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in q.judge(df).collect()), key=str)
    assert [g[5] for g in got if g[0] == 1] == [120000, 120000] and [g for g in got if g[0] is None][0][5:] == (0, False, True)
    assert [g for g in got if g[0] == 2][0][1:] == (0, 0, 0, 0, 0, True, False)
    assert q.judge(df.limit(0)).collect() == [] and q.filter_quality(df.limit(0)).columns == df.columns


def test_no_python_in_the_plan(spark):
    plan = q.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
