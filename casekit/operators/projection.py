"""A map of vectors in few dimensions: a neighbour graph by NN-descent, fuzzy weights on it,
and a layout by sampled gradients.

The graph starts from random neighbours and improves by rounds of joins: whoever a vector
knows, or is known by, are introduced to each other. Lists are bounded on both sides, so no
vector meets more than a fixed number of others in a round, however many know it. The layout
moves parts of the points at a time, with their neighbours elsewhere held still, and puts
the parts together after each round. All random choices follow from the seed and the order
of ids, so the same table gives the same points.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.vectors import unit
from ..sources.shared import discarded, written
from .curate import global_rank

#: Neighbours of a point; vectors introduced to each other, of those known and of those that know.
K, KNOWN = 15, 10
#: Rounds of the graph at most, and the share of changed edges that ends them.
GRAPH_ROUNDS, SETTLED = 12, 0.002
#: Rounds of the layout, passes over a part in each, points of a part, random others a move.
ROUNDS, PASSES, PART, OTHERS = 8, 40, 20_000, 5
#: The curve 1 / (1 + a d^(2 b)) of closeness over distance, for a least distance of 0.1.
CURVE = 1.577, 0.8951
_BATCH = 500


def _few_rows(spark: SparkSession):
    """Rows hold many vectors: hand workers few of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @contextlib.contextmanager
    def lowered():
        before = spark.conf.get(name)
        spark.conf.set(name, _BATCH)
        try:
            yield
        finally:
            spark.conf.set(name, before)

    return lowered()


def numbered(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(node, id, x): nodes from 0 in the order of ids, then of vectors, with unit vectors.
    Rows without a vector are left out."""
    rows = df.where(F.size(vec_col) > 0).select(F.col(id_col).alias("id"), unit(F.col(vec_col)).alias("x"))
    return written(global_rank(rows, [F.col("id"), F.col("x")]).select((F.col("_rank") - 1).alias("node"), "id", "x"), "nodes")


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of an array of lists one after the other, and where each list begins and the last ends."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _introduced(k: int):
    """Rows (node, met: array of (x, vector, least)) to (u, v, sim): the best pairs among
    those met that beat the least similarity in their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met, ends = _flat(batch.column(0))
            others, least = (met.field(c).to_numpy(zero_copy_only=False) for c in ("other", "least"))
            flat, cuts = _flat(met.field("x"))
            flat = flat.to_numpy(zero_copy_only=False).astype(float)
            us, vs, sims = [], [], []
            for start, end in zip(ends[:-1], ends[1:]):
                ids, first = np.unique(others[start:end], return_index=True)
                x = flat[cuts[start] : cuts[end]].reshape(end - start, -1)[first]
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                sim = np.take_along_axis(near, order, 1)
                a, at = np.nonzero(sim > least[start:end][first, None])
                us.append(ids[a])
                vs.append(ids[order[a, at]])
                sims.append(sim[a, at])
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
            yield pa.RecordBatch.from_arrays([join(us, pa.int64()), join(vs, pa.int64()), join(sims, pa.float64())], ["u", "v", "sim"])

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar of each u, each v once; ``new`` is 1 for an edge that was not there."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def neighbour_graph(nodes: DataFrame, k: int = K, seed: int = 42, rounds: int = GRAPH_ROUNDS, settled: float = SETTLED, known: int = KNOWN) -> DataFrame:
    """(u, v, sim): about the ``k`` nearest of each node of ``nodes`` (node, id, x) by cosine.

    In a round each node introduces at most ``known`` of those that it lists, as many of those
    that list it, and itself to each other. It ends after ``rounds``, or once less than
    ``settled`` of all entries change. A table of one row has no edges.
    """
    spark, n = nodes.sparkSession, nodes.count()
    empty = spark.createDataFrame([], "u long, v long, sim double")
    if n < 2:
        return empty
    pick = F.pmod(F.xxhash64("node", "j", F.lit(seed)), F.lit(n - 1))
    start = nodes.select("node", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j")).select(F.col("node").alias("u"), (pick + (pick >= F.col("node")).cast("long")).alias("v")).distinct()
    lists = written(start.select("u", "v", F.lit(-2.0).alias("sim"), F.lit(1).alias("new")), "neighbours")
    for turn in range(rounds):
        # Both directions, each cut to ``known`` by a hash; similar ones first would leave hubs alone with hubs.
        order = lambda by, turn=turn: Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64(*by, F.lit(seed + turn)), "other")
        few = lambda d, order=order: d.withColumn("_r", F.row_number().over(order(["node", "other"]))).where(F.col("_r") <= known).select("node", "other")
        out = few(lists.select(F.col("u").alias("node"), F.col("v").alias("other"), "new"))
        back = few(lists.select(F.col("v").alias("node"), F.col("u").alias("other"), "new"))
        met = out.unionByName(back).unionByName(nodes.select("node", F.col("node").alias("other"))).distinct()
        least = lists.where("sim > -2").groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("least"))
        info = nodes.join(least, F.col("node") == F.col("u"), "left").select(F.col("node").alias("other"), F.transform("x", lambda a: a.cast("float")).alias("x"), F.coalesce("least", F.lit(-2.0)).alias("least"))
        groups = met.join(info, "other").groupBy("node").agg(F.collect_list(F.struct("other", "x", "least")).alias("met")).select("met")
        with _few_rows(spark):
            found = groups.mapInArrow(_introduced(k), "u long, v long, sim double").withColumn("new", F.lit(1))
            after = written(_best(lists.where("sim > -2").withColumn("new", F.lit(0)).unionByName(found), k), "neighbours")
        discarded(spark, lists)
        lists, changed = after, after.where("new = 1").count()
        if changed <= settled * n * k:
            break
    return lists.select("u", "v", "sim")


def _memberships(k: int):
    """Rows (u, v: array of (sim, v)) to (u, v, p): how surely each is a neighbour. The nearest
    surely is; the others fade so that a point has log2(k) neighbours in all."""

    goal = np.log2(k)

    def sure(d: np.ndarray) -> np.ndarray:
        """Rows of distances of one length each to how surely each is a neighbour."""
        nearest = np.where(d > 0, d, np.inf).min(axis=1)
        over = np.maximum(d - np.where(np.isfinite(nearest), nearest, 0.0)[:, None], 0.0)
        low, high, width = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        open_ = np.ones(len(d), bool)
        for _ in range(64):
            total = np.exp(-over / width[:, None]).sum(axis=1)
            open_ &= np.abs(total - goal) >= 1e-5
            if not open_.any():
                break
            low, high = np.where(open_ & (total <= goal), width, low), np.where(open_ & (total > goal), width, high)
            width = np.where(open_, np.where(np.isfinite(high), (low + high) / 2, width * 2), width)
        mean = d.mean(axis=1)
        width = np.maximum(width, 1e-3 * np.where(mean == 0, 1.0, mean))
        return np.exp(-over / width[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met, ends = _flat(batch.column(1))
            d, sizes = np.maximum(1.0 - met.field("sim").to_numpy(), 0.0), np.diff(ends)
            p = np.zeros(len(d))
            for size in np.unique(sizes[sizes > 0]):
                at = ends[:-1][sizes == size, None] + np.arange(size)
                p[at] = sure(d[at])
            us = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), met.field("v"), pa.array(p)], ["u", "v", "p"])

    return run


def fuzzy_graph(edges: DataFrame, k: int = K) -> DataFrame:
    """(u, v, w): the weights of ``edges`` (u, v, sim), where either end is sure of the other:
    p + q - p q of both views. Edges stay with the ends that list them."""
    lists = edges.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("sim", "v"))).alias("met"))
    own = written(lists.mapInArrow(_memberships(k), "u long, v long, p double"), "memberships")  # read for both views
    other = own.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("p").alias("q"))
    return own.join(other, ["u", "v"], "left").select("u", "v", (F.col("p") + F.coalesce(F.col("q"), F.lit(0.0)) * (1 - F.col("p"))).alias("w"))


def _moved(dims: int, turn: int, seed: int, rate: float):
    """Points of one part, after some passes over their edges."""
    a, b = CURVE

    def added(move: np.ndarray, t: np.ndarray, size: np.ndarray, gap: np.ndarray) -> None:
        steps = np.clip(size[:, None] * gap, -4, 4)
        for d in range(dims):  # sums along one axis at a time have a fast path
            np.add.at(move[d], t, np.ascontiguousarray(steps[:, d]))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node").combine_chunks()
        one = lambda c: rows[c].chunk(0)
        node = one("node").to_numpy()
        y = one("y").flatten().to_numpy().astype(float).reshape(-1, dims)
        met, ends = _flat(one("met"))
        tail, heads = np.repeat(np.arange(len(node)), np.diff(ends)), met.field("v").to_numpy()
        order = np.lexsort((heads, tail))
        tail, heads, w = tail[order], heads[order], met.field("w").to_numpy()[order]
        still = met.field("y").flatten().to_numpy().astype(float).reshape(-1, dims)[order]
        at = np.minimum(np.searchsorted(node, heads), len(node) - 1)
        here = node[at] == heads if len(heads) else np.zeros(0, bool)
        rng = np.random.default_rng([seed, turn, rows["part"][0].as_py()])
        chance = w / w.max() if len(w) else w
        for step in range(PASSES):
            speed = rate * (1 - step / PASSES)
            some = np.flatnonzero(rng.random(len(chance)) < chance)
            t = tail[some]
            gap = y[t] - np.where(here[some, None], y[at[some]], still[some])
            far = (gap**2).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(far > 0, -2 * a * b * far ** (b - 1) / (1 + a * far**b), 0.0)
            move = np.zeros((dims, len(y)))
            added(move, t, pull, gap)
            for _ in range(OTHERS):
                o = rng.integers(0, len(node), len(t))
                gap = y[t] - y[o]
                far = (gap**2).sum(axis=1)
                push = np.where(o != t, 2 * b / ((0.001 + far) * (1 + a * far**b)), 0.0)
                added(move, t, push, gap)
            y += speed * move.T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, dims, dtype=np.int32)), pa.array(y.ravel()))
        return pa.table({"node": pa.array(node), "y": lists})

    return run


def laid_out(nodes: DataFrame, weights: DataFrame, dims: int = 3, seed: int = 42, rounds: int = ROUNDS, rate: float = 0.5) -> DataFrame:
    """(node, y): points whose closeness follows ``weights`` (u, v, w).

    They start at a random projection of the vectors. In a round, points are dealt out by a
    hash to parts of about ``PART``, drawn to the neighbours that they list and pushed from
    random others of their part; neighbours of other parts stand where the last round left
    them. Moves are drawn with the edges' weights as chances, at a falling rate.
    """
    spark, n = nodes.sparkSession, nodes.count()
    parts = max(1, -(-n // PART))
    dim = nodes.select(F.max(F.size("x"))).first()[0] or 0
    axes = np.random.default_rng(seed).normal(size=(dims, dim))
    along = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(c)) for c in axis]), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p) for axis in axes]
    points = written(nodes.select("node", F.array(*[10 * c for c in along]).alias("y")), "points")
    for turn in range(rounds):
        there = points.select(F.col("node").alias("v"), F.col("y"))
        met = weights.join(there, "v").groupBy(F.col("u").alias("node")).agg(F.collect_list(F.struct("v", "w", "y")).alias("met"))
        part = F.pmod(F.xxhash64("node", F.lit(seed + turn)), F.lit(parts)).alias("part")
        rows = points.join(met, "node", "left").select("node", "y", "met", part)
        after = written(rows.groupBy("part").applyInArrow(_moved(dims, turn, seed, rate * (1 - turn / rounds)), "node long, y array<double>"), "points")
        discarded(spark, points)
        points = after
    return points


def projected(df: DataFrame, id_col: str, vec_col: str, dims: int = 3, k: int = K, seed: int = 42) -> DataFrame:
    """(id, point): ``dims`` coordinates of every row of ``df`` that has a vector, near to each
    other where the vectors' cosine is large. Ids may repeat or be null; a single row is a
    point of its own; an empty table gives none. Vectors have one length and finite entries."""
    nodes = numbered(df, id_col, vec_col)
    weights = written(fuzzy_graph(neighbour_graph(nodes, k, seed), k), "fuzzy_graph")
    points = laid_out(nodes, weights, dims, seed)
    return nodes.select("node", F.col("id").alias(id_col)).join(points, "node").select(id_col, F.col("y").alias("point"))
