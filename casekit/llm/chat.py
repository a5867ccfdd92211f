"""Conversations formatted in budgeted windows, with a loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not occur in a role or text as they are: the template's marks, and
#: marks of other templates.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Tokens of a window, and of repeated history in it.
BUDGET, HISTORY = 1024, 192
#: Tokens of a turn's marks.
MARKS = 4


def escape(text: Column) -> Column:
    """``text`` without control strings: backslashes are doubled, and a control string
    gets one after its first character. No other place has an odd run of them between
    those two characters, so ``unescape`` restores the text."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for c in CONTROL:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Estimate of a turn's tokens: runs of ASCII word characters and each other
    character that is not ASCII white space, and the marks. At least ``MARKS``. The budget is
    one of this estimate: a tokenizer can't be run by DataFrame functions; where its tokens
    are what counts, pass a budget that is smaller by its tokens per unit of the estimate."""
    return (F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]")) + MARKS).cast("long")


def format_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """Windows of conversations: (id, window, n_turns, n_repeated, text, loss).

    A conversation's turns in the order of ``turn`` (ties: role, text; nulls first) have
    prefix sums of their tokens (``turn_tokens``, an estimate), by which spans are packed: a
    leading system turn opens every window; a window's new turns go on until the next one
    would pass what the budget leaves beside the system turn and the room for history, and
    that next turn begins the next window. Between the system turn and the new turns stand
    the turns before them that fit in the room for history: ``history`` tokens or, before
    a long turn, what that leaves; the first window has none. So a window keeps the budget
    unless a single new turn, with the system turn, does not fit; such a turn stands alone
    and is not cut. ``loss`` has struct(start, length) in code points of the texts of
    assistant turns that are new in their window: repeated turns are masked, so each is a
    target once. The first ``n_repeated`` turns of a window repeat others. Null texts and
    roles are empty; a null id is a conversation of its own; repeated rows are turns of
    their own; other columns are not read. A conversation is one row, and is packed in one
    task.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be smaller than the budget")
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), turn_tokens(text).alias("n"))
    packed = turns.select(F.col(id_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    system = F.get("turns", F.lit(0))["role"] == "system"
    packed = packed.select("conv", "turns", F.when(system, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)).alias("head"))
    room = F.lit(budget) - F.aggregate("head", F.lit(0).cast("long"), lambda a, t: a + t["n"])
    packed = packed.select("conv", "turns", "head", room.alias("room"), F.size("head").alias("first"))
    # (turns so far, tokens that the window may still take, places where windows begin)
    none = F.struct(F.lit(0).alias("place"), F.lit(None).cast("long").alias("left"), F.expr("cast(array() as array<int>)").alias("starts"))

    def step(acc: Column, t: Column) -> Column:
        skip = acc["place"] < F.col("first")
        opens = ~skip & F.coalesce(acc["left"] < t["n"], F.lit(True))
        back = F.greatest(F.lit(0).cast("long"), F.least(F.lit(history).cast("long"), F.col("room") - t["n"]))
        left = F.when(opens, F.col("room") - t["n"] - F.when(acc["left"].isNull(), F.lit(0).cast("long")).otherwise(back)).when(skip, acc["left"]).otherwise(acc["left"] - t["n"])
        return F.struct((acc["place"] + 1).alias("place"), left.alias("left"), F.when(opens, F.concat(acc["starts"], F.array(acc["place"]))).otherwise(acc["starts"]).alias("starts"))

    starts = F.aggregate("turns", none, step, lambda acc: acc["starts"])
    packed = packed.select("*", F.when(F.size("turns") > F.col("first"), starts).otherwise(F.array(F.lit(1))).alias("starts"), F.size("turns").alias("count"))
    spans = F.transform("starts", lambda a, i: F.struct(i.alias("at"), a.alias("a"), F.coalesce(F.get("starts", i + 1), F.col("count")).alias("b")))
    packed = packed.select("conv", "turns", "head", "room", "first", F.explode(spans).alias("w")).select("conv", "turns", "head", "room", "first", "w.*")
    fresh = F.slice("turns", F.col("a") + 1, F.greatest(F.lit(0), F.col("b") - F.col("a")))
    most = F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.lit(history).cast("long"), F.col("room") - F.get("turns", F.col("a"))["n"])))
    # A turn has one token or more, so that no more than ``history`` of them can fit.
    before = F.slice("turns", F.greatest(F.col("first"), F.col("a") - history) + 1, F.greatest(F.lit(0), F.least(F.lit(history), F.col("a") - F.col("first"))))
    count = F.aggregate(
        F.reverse("before"),
        F.struct(F.col("most").alias("left"), F.lit(0).alias("k")),
        lambda acc, t: F.struct((acc["left"] - t["n"]).alias("left"), (acc["k"] + F.when(acc["left"] >= t["n"], 1).otherwise(0)).alias("k")),
        lambda acc: acc["k"],
    )
    packed = packed.select("conv", "at", "head", "first", fresh.alias("fresh"), before.alias("before"), most.alias("most"))
    packed = packed.select("conv", "at", "head", "fresh", F.slice("before", F.size("before") - count + 1, count).alias("back"))
    opening = F.transform("head", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (F.col("at") == 0).alias("fresh")))
    marked = lambda new: lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(new).alias("fresh"))
    rest = [F.transform("back", marked(False)), F.transform("fresh", marked(True))]
    packed = packed.select("conv", "at", F.concat(opening, *rest).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"),
            (t["fresh"] & (t["role"] == "assistant")).alias("target"), t["fresh"].alias("fresh"),
        ),
    )
    packed = packed.select("conv", "at", parts.alias("parts"))
    sizes = F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["target"].alias("target")))
    packed = packed.select("conv", "at", "parts", sizes.alias("sizes"))

    def mark(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["head"]
        more = F.concat(acc["out"], F.array(F.struct(start.alias("start"), p["body"].alias("length"))))
        return F.struct((start + p["body"] + len(END)).alias("at"), F.when(p["target"], more).otherwise(acc["out"]).alias("out"))

    none = F.expr("cast(array() as array<struct<start: int, length: int>>)")
    loss = F.aggregate("sizes", F.struct(F.lit(0).alias("at"), none.alias("out")), mark, lambda acc: acc["out"])
    return packed.select(
        F.col("conv").alias(id_col), F.col("at").alias("window"), F.size("parts").alias("n_turns"),
        F.size(F.filter("parts", lambda p: ~p["fresh"])).alias("n_repeated"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"), loss.alias("loss"),
    )


def parse_windows(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``windows`` with ``turns``, an array of struct(role, text) of the turns that are
    new in it, and ``targets``, the unescaped texts under the loss mask, read from the text."""
    units = F.filter(F.split("text", r"\Q" + END + r"\E", -1), lambda u: u.startswith(TURN))
    units = F.slice(units, F.col("n_repeated") + 1, F.greatest(F.size(units) - F.col("n_repeated"), F.lit(0)))

    def read(unit: Column) -> Column:
        both = F.split(F.substring(unit, F.lit(len(TURN) + 1), F.length(unit)), r"\Q" + TEXT + r"\E", 2)
        return F.struct(unescape(both[0]).alias("role"), unescape(both[1]).alias("text"))

    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select(id_col, "window", "text", F.transform(units, read).alias("turns"), targets.alias("targets"))


def conversation_digests(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, from its formatted windows: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    read = parse_windows(windows, id_col)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    one = read.select(id_col, "window", F.length("text").alias("chars"), F.size("turns").alias("n"), said.alias("said"), F.array_join("targets", "").alias("loss"))
    per = one.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said, loss = (F.array_join(F.expr(f"transform(w, x -> x.{k})"), "") for k in ("said", "loss"))
    return per.select(id_col, F.col("n_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
