"""Mixing sources to target weights by the cube method of balanced sampling."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from casekit.operators.curate import global_rank

from ._common import bound_batches, discard, drop_worker_caches, free_name, materialize

WEIGHTS = (1, 2, 3)
CAP = 3
#: Open units of a source with which the landing begins.
LANDING = 12
#: Documents of a source, about, that fly last, to make good what large ones add.
RESERVE = 200
#: Share of a source's expected total (or twice the median size, if that is more) by which the
#: draw of a document that others cannot make good may miss the total; beyond that the total
#: comes first.
SLACK = 0.01
_EPS = 1e-9


def word_count(text: Column | str) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per source of ``sizes`` (source, size): source, source_size, n_docs, target.

    Sources by code point, null last, take ``weights`` in turn and share the total size in
    proportion; a target stops at ``cap`` times its source's size and the excess goes to
    the others by weight: target = min(cap * size, level * weight), where the level is
    fixed by the total. Sources are ranked by ranges of their order. The level is found
    by aggregates over the sources: those above their stop at the level so far are taken
    out, which raises it, until none is.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = global_rank(per, [F.col("source").asc_nulls_last()])
    per = per.withColumn("weight", F.element_at(turn, ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))).drop("_rank")
    per = materialize(per.withColumn("most", F.col("source_size") * F.lit(float(cap))), "sources")
    total, level, n_over = per.agg(F.sum("source_size")).first()[0] or 0, -1.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("most")
        stopped, open_weight, n = per.agg(F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == n_over or not open_weight:
            break
        level, n_over = (total - cap * (stopped or 0)) / open_weight, n
    target = F.when(over, F.col("most")).otherwise(F.least("most", F.lit(level) * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def flight(share: np.ndarray, size: np.ndarray, rng: np.random.Generator, stop: int = 2) -> np.ndarray:
    """Move ``share`` (inclusion probabilities) along null vectors of the two balancing
    constraints, total size and number, until ``stop`` (2 or more) or fewer are strictly
    between 0 and 1.

    Three open units a, b, c have the null vector (b - c, c - a, a - b) of their sizes, or
    (1, -1, 0) where these agree. The step up or down is drawn so that each share keeps
    its expectation.
    """
    x = share.astype(float).tolist()
    s = size.astype(float).tolist()
    todo = [i for i in range(len(x)) if _EPS < x[i] < 1 - _EPS]
    draws = rng.random(len(todo) + 1).tolist()
    open_: list[int] = []
    nxt = 0
    while True:
        while len(open_) < 3 and nxt < len(todo):
            open_.append(todo[nxt])
            nxt += 1
        if len(open_) < 3 or len(open_) + len(todo) - nxt <= stop:
            return np.array([0.0 if v <= _EPS else 1.0 if v >= 1 - _EPS else v for v in x])
        a, b, c = (s[i] for i in open_)
        u = (b - c, c - a, a - b)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - x[i]) / v if v > 0 else x[i] / -v for i, v in zip(open_, u, strict=True) if v)
        down = min(x[i] / v if v > 0 else (1 - x[i]) / -v for i, v in zip(open_, u, strict=True) if v)
        step = up if draws.pop() * (up + down) < down else -down
        for i, v in zip(open_, u, strict=True):
            x[i] += step * v
        left = [i for i in open_ if _EPS < x[i] < 1 - _EPS]
        if len(left) == 3:  # rounding kept the unit that should have stopped
            near = min(left, key=lambda i: min(x[i], 1 - x[i]))
            x[near] = float(round(x[near]))
            left.remove(near)
        if not draws:
            draws = rng.random(len(todo) + 1).tolist()
        open_ = left


def _draw(x: np.ndarray, size: np.ndarray, i: int, want: float, slack: float, rng: np.random.Generator) -> None:
    """Settle unit ``i`` of ``x``: a step along the null vector of the total size that moves
    it against all other open units, each as far as it can make good. Drawn up or down so
    that every share keeps its expectation. Where the others cannot make it good: by its
    share, too, if the total then stays within ``slack`` of ``want`` either way; else to
    its nearer side, and what the others can they still make good."""
    others = np.flatnonzero((x > _EPS) & (x < 1 - _EPS))
    others = others[others != i]
    p, error = float(x[i]), float(x @ size) - want
    room = np.minimum(x[others] / (1 - p), (1 - x[others]) / p)
    able = float(room @ size[others])
    x[i] = float(rng.random() < p)
    up, down = abs(error + (1 - p) * size[i]), abs(error - p * size[i])
    if able >= size[i] > 0:
        x[others] -= room * ((x[i] - p) * size[i] / able)
    elif max(up, down) > slack:
        x[i] = float(up < down)
        error += (x[i] - p) * size[i]
        far = 1 - x[others] if error < 0 else -x[others]
        x[others] += far * min(1.0, abs(error) / max(_EPS, abs(float(far @ size[others]))))
    x[others] = np.clip(x[others], 0.0, 1.0)
    x[x <= _EPS] = 0.0
    x[x >= 1 - _EPS] = 1.0


def settle(share: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last flight and the landing of a source.

    A unit far larger than the others would stay open to the end and land by itself. So
    units over four times the median size are drawn first, largest first, against all
    others. The rest fly on both constraints until ``LANDING`` or fewer are open. Then the
    constraints are relaxed one by one: the number is given up, and the open units are
    drawn against the smaller ones, largest first, which keeps the total size; the last
    has nothing to be held against. Shares keep their expectations throughout, but for a
    unit that would move the total by more than ``SLACK`` says and that all others together
    cannot make good: there the total comes first, as it does in sources with ``LANDING`` or
    fewer open documents, which have no room for both.
    """
    out = share.astype(float).copy()
    if not len(out):
        return out
    want = float(out @ size)
    find = lambda: np.flatnonzero((out > _EPS) & (out < 1 - _EPS))
    first = find()
    slack = max(SLACK * want, 2 * float(np.median(size))) if len(first) > LANDING else 0.0
    if len(first) > LANDING:
        for i in sorted(first[size[first] > 4 * float(np.median(size[first]))].tolist(), key=lambda i: (-size[i], i)):
            if _EPS < out[i] < 1 - _EPS:
                _draw(out, size, i, want, slack, rng)
        out = flight(out, size, rng, LANDING)
    for i in sorted(find().tolist(), key=lambda i: (-size[i], i)):
        if _EPS < out[i] < 1 - _EPS:
            _draw(out, size, i, want, slack, rng)
    return out


def _block_flight(seed: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        drop_worker_caches()
        rows = rows.sort_values(["order", "size"], kind="stable").reset_index(drop=True)
        mark = hashlib.blake2b(repr((seed, str(key[0]), int(key[1]))).encode(), digest_size=8).digest()
        rng = np.random.default_rng(int.from_bytes(mark, "little"))
        size = rows["size"].to_numpy(float)
        rows["share"] = (settle if last else flight)(rows["share"].to_numpy(float), size, rng)
        return rows

    return run


_FLYING = ("id", "source", "size", "order", "source_size", "n_docs", "target", "whole", "share")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    text_col: str = "text",
    weights=WEIGHTS,
    cap: float = CAP,
    seed: int = 11,
    block: int = 1000,
) -> DataFrame:
    """One row per row of ``docs``: (id, source, size, source_size, target, copies, taken).

    A document is taken ``floor(r)`` times, r being target over size of its source, and
    once more if the cube method chooses it with inclusion probability r - floor(r),
    balanced on the sum of sizes and the number of documents of its source. ``taken`` is
    size times copies. The flight runs in blocks of about ``block`` documents of a source
    (a source with most of the rows has most of the blocks), each of which leaves two
    open units or fewer; these meet in new blocks until a source has one. There a reserve
    of about ``RESERVE`` documents joins them (where one block holds every source, all its
    documents are there already), and they are settled: the total comes near its target,
    each document keeps its share, but for one that is too large for both; see ``settle``.
    The number of documents is balanced by the flights alone. Draws are seeded by source and block and
    documents ordered by a hash of id and size, so that reruns agree. Null texts have size
    0, null is a source of its own, repeated rows count each, ids may be null.
    """
    bound_batches(docs.sparkSession)
    size = word_count(F.col(text_col)) if size is None else size
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"))
    rows = materialize(rows.withColumn("order", F.xxhash64(F.col("id").cast("string"), "source", F.lit(seed))), "sizes")
    targets = materialize(source_targets(rows, weights, cap), "targets")
    rows = rows.join(targets, rows.source.eqNullSafe(targets.source), "left").drop(targets.source)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(ratio + F.lit(_EPS)).cast("int"))
    rows = rows.withColumn("share", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    blocks = F.ceil(F.col("n_docs") / block)
    # A share of the hash range, as large as the reserve is of the source.
    kept_back = F.pmod(F.xxhash64("order"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * RESERVE / F.col("n_docs")
    reserve = rows.where(kept_back) if most > block else None
    rows = rows if reserve is None else rows.where(~kept_back)
    done = []
    level = 0
    while True:
        last = most <= block
        if last and reserve is not None:
            rows = rows.unionByName(reserve.select(*rows.columns))
        at = F.lit(0) if last else F.pmod(F.shiftright("order", level % 8), F.greatest(blocks, F.lit(1))).cast("int")
        now = rows.withColumn("block", at)
        now = now.select(*_FLYING, "block")
        moved = now.groupBy("source", "block").applyInPandas(_block_flight(seed + level, last), now.schema)
        moved = materialize(moved, f"flight{level}")
        if last:
            done.append(moved)
            break
        closed = (F.col("share") <= _EPS) | (F.col("share") >= 1 - _EPS)
        done.append(moved.where(closed))
        rows = moved.where(~closed).select(*_FLYING)
        level += 1
        blocks = F.ceil(F.col("n_docs") * F.pow(F.lit(3.0 / block), F.lit(level)) / block)
        most = most * 3.0 / block
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("share").cast("int")
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size").cast("long").alias("source_size"),
        "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` takes it.

    Copies are joined to the documents by id, source and size; of rows that agree in all
    three the sums of their copies are dealt out in the order of their text's hash. What is
    chosen grows with the documents, so it is merged at every size and never broadcast.
    Documents without words are taken as often as their inclusion says, like any other.
    """
    size = word_count(F.col(text_col))
    i, s, n, c, k, copies, at = free_name(docs, "_i", "_s", "_n", "_c", "_k", "_copies", "_at")
    chosen = mix_sources(docs, id_col, source_col, text_col=text_col, **how)
    chosen = chosen.groupBy(F.col(id_col).alias(i), F.col(source_col).alias(s), F.col("size").alias(n)).agg(F.sum("copies").alias(c), F.count("*").alias(k))
    chosen = materialize(chosen.where(F.col(c) > 0), "chosen").hint("merge")
    found = docs.join(chosen, docs[id_col].eqNullSafe(chosen[i]) & docs[source_col].eqNullSafe(chosen[s]) & (size == chosen[n]))
    one = found.where(F.col(k) == 1).select(*docs.columns, F.col(c).cast("long").alias(copies))
    alike = Window.partitionBy(i, s, n).orderBy(F.xxhash64(text_col))
    share = F.floor(F.col(c) / F.col(k)) + F.when(F.row_number().over(alike) <= F.col(c) % F.col(k), 1).otherwise(0)
    many = found.where(F.col(k) > 1).withColumn(copies, share.cast("long")).select(*docs.columns, copies)
    both = one.unionByName(many).where(F.col(copies) > 0)
    return both.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
