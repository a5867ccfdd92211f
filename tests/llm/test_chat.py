import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casekit.llm import chat


def make(seed=1):
    rng = random.Random(seed)
    bits = [*chat.CONTROL, "\\", "<", "|", "<\\", "[", "word ", "É", "\n", "", "<|", "end|>", "/s>"]
    rows = []
    for c in range(40):
        n = rng.randint(1, 30)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(("user", "assistant", "tool", None, "a<|text|>b"))
            rows.append((c, t, role, None if rng.random() < 0.05 else "".join(rng.choices(bits, k=rng.randint(0, 30))) + "word " * rng.choice((0, 3, 40))))
    rows += [(50, t, "assistant" if t % 2 else "user", "w " * 200) for t in range(60)]
    return rows + [(60, 0, "system", "only"), (None, 0, "user", "null id"), (61, 0, "user", "tie"), (61, 0, "assistant", "tie"), (61, 0, "user", "tie"), (61, None, "user", "first"), (62, 0, "user", "x " * 5000), (62, 1, "assistant", "y")]


SCHEMA = "conv_id long, turn int, role string, text string"


def test_escape_is_reversible(spark):
    rng = random.Random(2)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "|", "/", "s>", "[", "INST]", "x", "<|end", "|>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


@pytest.mark.parametrize("budget,history", [(1024, 192), (120, 30), (40, 0)])
def test_round_trip(spark, budget, history):
    rows = make()
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", window string")
    windows = chat.format_conversations(df, budget=budget, history=history)
    got = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    size = lambda text: len(__import__("re").findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]", text)) + chat.MARKS
    parsed = {(r.conv_id, r.window): r for r in windows.collect()}
    heads = {c: t[0][3] for c, t in by.items() if sorted(t)[0][2] == "system"}
    for (c, w), r in parsed.items():
        units = [u for u in r.text.split(chat.END) if u]
        assert len(units) == r.n_turns
        if c in heads:
            assert units[0].startswith(chat.TURN + "system" + chat.TEXT)
        undo = lambda x: __import__("functools").reduce(lambda a, k: a.replace(k[0] + "\\" + k[1:], k), chat.CONTROL, x).replace("\\\\", "\\")
        sizes = [size(undo(u.split(chat.TEXT, 1)[1])) for u in units]
        head = sizes[0] if c in heads else 0
        repeated, new = sizes[(1 if head else 0) : r.n_repeated] if w else [], sizes[r.n_repeated :] if w else sizes[(1 if head else 0) :]
        assert sum(repeated) <= history
        assert sum(sizes) <= budget or len(new) == 1 and not repeated
        follows = parsed.get((c, w + 1))
        if follows is not None:  # the next turn did not fit, even with as much history as there may be
            after = size(undo([u for u in follows.text.split(chat.END) if u][follows.n_repeated].split(chat.TEXT, 1)[1]))
            assert head + sum(new) + after + (min(history, max(0, budget - head - new[0])) if w else 0) > budget
    windows_of = {c: sorted(w for d, w in parsed if d == c) for c, _ in parsed}
    assert all(ws == list(range(len(ws))) for ws in windows_of.values())


def by_hand(turns, budget, history):
    """[(repeated, new)] as lists of places, for turns [(role, tokens)]."""
    first = 1 if turns and turns[0][0] == "system" else 0
    room, out, i = budget - sum(n for _, n in turns[:first]), [], first
    while i < len(turns):
        back = max(0, min(history, room - turns[i][1])) if out else 0
        j, held = i, 0
        while j > first and held + turns[j - 1][1] <= back:
            j -= 1
            held += turns[j][1]
        k, used = i + 1, turns[i][1]
        while k < len(turns) and used + turns[k][1] <= room - back:
            used += turns[k][1]
            k += 1
        out.append((list(range(j, i)), list(range(i, k))))
        i = k
    return out or [([], [])]


def test_spans_against_a_loop(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for c in range(120):
        turns = [("system" if t == 0 and c % 2 else "user", rng.choice((5, 9, 30, 60, 101, 130))) for t in range(rng.randint(1, 25))]
        rows += [(c, t, r, " ".join(f"t{t}" for _ in range(n - chat.MARKS))) for t, (r, n) in enumerate(turns)]
        want[c] = by_hand(turns, 128, 40)
    got = {}
    for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA), budget=128, history=40).orderBy("conv_id", "window").collect():
        places = [int(u.split(chat.TEXT)[1].split()[0][1:]) for u in r.text.split(chat.END) if u]
        skip = 1 if r.conv_id % 2 else 0
        got.setdefault(r.conv_id, []).append((places[skip : r.n_repeated] if r.window else [], places[r.n_repeated if r.window else skip :]))
    assert got == want


def test_nothing_and_bad_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_digests(chat.format_conversations(empty)).count() == 0
    with pytest.raises(ValueError):
        chat.format_conversations(empty, budget=5, history=5)
    plan = chat.conversation_digests(chat.format_conversations(empty))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
