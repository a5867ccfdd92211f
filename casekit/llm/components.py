"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import discard, materialize, release


#: Nodes whose minima are sent to all tasks, at most: those with most edges.
_HUBS = 100_000


def _attach(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``rows`` (u, v) with the ``m`` of their u in ``least`` (u, m, n): hubs' rows stay where
    they are and meet their minimum there, as hubs are few; the others are dealt out by u."""
    hub = F.col("n") > max(256, n_edges // _HUBS * 2)
    hubs = F.broadcast(least.where(hub).select("u", F.col("m").alias("hub_m")))
    known = rows.join(hubs, "u", "left")
    # A merge join: broadcasts of small tables, one after the other, cost the driver more.
    rest = known.where("hub_m is null").join(least.where(~hub).select("u", "m").hint("merge"), "u")
    return known.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node that it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _attach(both.where("v > u"), least, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _attach(edges, least, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges`` (u, v) with the smallest node of its component.

    Returns (node, root), one row per node that has an edge to another node; a node that
    only has an edge to itself, or none, has no row. Null ends are ignored, repeated edges
    count once, and an empty table gives an empty table. Minima are aggregated with a
    map-side combine. The edges of a node with more than 256 of them (and more than a share
    of all that bounds the number of such nodes) are not moved to one task: its minimum is
    sent to them. Each round is written to the shared folder. Raises if ``max_rounds`` do
    not suffice.
    """
    now = materialize(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    n_edges, seen = now.count(), None
    for _ in range(max_rounds):
        if not n_edges:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = materialize(_large_star(now, n_edges), "large")  # read several times
        after = materialize(_small_star(large, n_edges), "star")
        discard(large)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        release(now.sparkSession)
        now = after
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_labels(edges: DataFrame, hops: int = 4) -> DataFrame:
    """(node, root): a label of each node of ``edges`` (u, v), such that nodes with the same
    one are connected: the least node within ``hops`` edges. Groups around a few hubs get one
    label each; wider components may keep several, which ``connected_components`` would
    join. No rounds to a fixed point; every two hops are written, so that the driver plans
    and runs few shuffles at a time."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    out = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
    for hop in range(1, hops):
        if hop % 2 == 0:
            out = materialize(out, "labels")
        known = out.select(F.col("node").alias("other"), "root").hint("merge")
        out = both.join(known, "other").groupBy("node").agg(F.min("root").alias("root"))
    return out
