"""Nearest candidates by an inverted file over directions, exact or by a few cells.

Directions are dealt out to cells by the centroid that they point to most. A candidate x is
kept with its part along its cell's centroid and the length of what is left of it, so that
for a query q: q.x <= (q along) (x along) + |q aside| |x aside|. What a run of candidates of
one cell can reach at most follows from their extremes, and a run that can't reach a query's
n-th best similarity so far is passed over. The cells nearest to a query give it a first n-th
best; exact search then passes over all runs once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import weighted_direction
from ..sources.shared import written

#: Directions that the centroids are fitted on, about; rounds of the fit; most cells.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 4096
#: Bytes of queries that go to all tasks at once, about.
BLOCK_BYTES = 16 << 20
#: Room for rounding when a bound is compared.
_SLACK = 1e-9
_SPREAD = 16


def centroids(x: np.ndarray, count: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """Unit vectors that the rows of ``x`` point to: spherical k-means from random rows. A
    cell that loses all its rows starts again at the row that is worst off."""
    sizes = np.linalg.norm(x, axis=1)
    u = x[sizes > 0] / sizes[sizes > 0, None]
    if not len(u):
        return np.eye(1, x.shape[1]) if x.shape[1] else np.zeros((1, 0))
    c = u[np.random.default_rng(seed).permutation(len(u))[: min(count, len(u))]].copy()
    for _ in range(rounds):
        near = u @ c.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, u)
        size = np.linalg.norm(sums, axis=1)
        worst = np.argsort(near.max(axis=1), kind="stable")
        for k, i in zip(np.flatnonzero(size < 1e-12), worst):
            sums[k], size[k] = u[i], 1.0
        c = sums / size[:, None]
    return c


@dataclass(frozen=True)
class VectorIndex:
    """Candidates in the shared folder, dealt out by cell, with the cells' centroids."""

    table: DataFrame
    centers: np.ndarray
    keep: tuple[str, ...]


def _assigned(centers: np.ndarray, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dim = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(names.index("direction")), dim)
            near = x @ centers.T
            cell = near.argmax(axis=1)
            along = near[np.arange(len(x)), cell]
            aside = np.linalg.norm(x - along[:, None] * centers[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(along), pa.array(aside)], [*names, "cell", "along", "aside"])

    return run


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` entries; a missing or empty direction is the zero vector."""
    if column.null_count == 0 and len(column.flatten()) == len(column) * dim:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        if v:
            out[i] = v
    return out


def build_vector_index(candidates: DataFrame, id_col: str, case_type: str, vectors: str, keep: tuple[str, ...] = (), cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Index all rows of ``candidates`` that have an id and a case type; a row is one
    direction, as of ``weighted_direction`` of its ranked ``vectors``.

    Centroids are fitted on about ``SAMPLE`` rows, and are the square root of the number of
    rows, at most ``MOST_CELLS``, unless ``cells`` says otherwise. Rows are dealt out by
    ranges of cells, a large cell over several tasks. Directions of unequal length raise.
    """
    rows = candidates.where(F.col(id_col).isNotNull() & F.col(case_type).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(case_type).cast("string").alias("case"), weighted_direction(F.col(vectors)).alias("direction"), *keep)
    n, low, high = rows.agg(F.count("*"), F.min(F.nullif(F.size("direction"), F.lit(0))), F.max(F.size("direction"))).first()
    if high and high > 0 and low != high and low is not None and low > 0:
        raise ValueError(f"directions of {low} to {high} entries")
    dim = max(high or 0, 0)
    some = rows.select("direction").sample(min(1.0, SAMPLE / max(n, 1)), seed).toArrow()
    x = _vectors(some["direction"].combine_chunks(), dim)
    centers = centroids(x, cells or max(1, min(MOST_CELLS, int(n**0.5))), seed) if len(x) else np.zeros((1, dim))
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("along", DoubleType()), StructField("aside", DoubleType())])
    dealt = rows.mapInArrow(_assigned(centers, rows.columns), schema)
    spread = F.pmod(F.xxhash64("id"), F.lit(_SPREAD))
    return VectorIndex(written(dealt.repartitionByRange("cell", spread).sortWithinPartitions("cell", "along"), "vector_index"), centers, keep)


@dataclass(frozen=True)
class _Queries:
    ids: list
    cases: np.ndarray
    x: np.ndarray
    along: np.ndarray
    aside: np.ndarray


def _key(hit: tuple) -> tuple:
    return -hit[0], hit[1]


def _scanned(queries: _Queries, n: int, floors: np.ndarray, names: list[str], keep: tuple[str, ...], only: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates to (q, id, similarity, direction, keep): a task's ``n`` best of each query
    that reach its floor, and a last row (q = -1) with the number of pairs compared. With
    ``only`` (queries by cells), the cells that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, best, pairs, kinds = floors.copy(), [[] for _ in queries.ids], 0, None
        for batch in batches:
            at = {c: batch.column(names.index(c)) for c in names}
            kinds = [at["id"].type, *[at[c].type for c in keep]]
            cell, along, aside = (at[c].to_numpy() for c in ("cell", "along", "aside"))
            x, cases = _vectors(at["direction"], queries.x.shape[1]), np.array(at["case"].to_pylist(), dtype=object)
            order = np.argsort(cell, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else ():
                k = cell[some[0]]
                q_along = queries.along[:, k]
                reach = np.maximum(q_along * along[some].min(), q_along * along[some].max()) + queries.aside[:, k] * aside[some].max() + _SLACK
                active = np.flatnonzero((reach >= least) & (only[:, k] if only is not None else True))
                if not len(active):
                    continue
                pairs += len(active) * len(some)
                near = x[some] @ queries.x[active].T
                near[cases[some][:, None] != queries.cases[active][None, :]] = -np.inf
                for j, q in enumerate(active):
                    hits = some[near[:, j] >= max(least[q] - _SLACK, -1e300)]
                    if not len(hits):
                        continue
                    exact = (x[hits] * queries.x[q]).sum(axis=1)  # the same for equal rows, wherever they stand
                    found = [(float(s), at["id"][int(i)].as_py(), x[i].tolist(), *[at[c][int(i)].as_py() for c in keep]) for s, i in zip(exact, hits) if s >= least[q]]
                    best[q] = sorted(best[q] + [h for h in found if h[1] != queries.ids[q]], key=_key)[:n]
                    if len(best[q]) == n:
                        least[q] = max(least[q], best[q][-1][0])
        if kinds is not None:
            rows = [(q, h[1], h[0], h[2], *h[3:]) for q, hits in enumerate(best) for h in hits] + [(-1, None, float(pairs), None, *[None] * len(keep))]
            types = [pa.int32(), kinds[0], pa.float64(), pa.list_(pa.float64()), *kinds[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["q", "id", "similarity", "direction", *keep])

    return run


def _scan(index: VectorIndex, rows: DataFrame, queries: _Queries, n: int, floors: np.ndarray, only: np.ndarray | None = None) -> DataFrame:
    fields = {f.name: f for f in index.table.schema.fields}
    schema = StructType([StructField("q", IntegerType()), fields["id"], StructField("similarity", DoubleType()), StructField("direction", ArrayType(DoubleType())), *[fields[c] for c in index.keep]])
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    return rows.mapInArrow(_scanned(queries, n, floors, index.table.columns, index.keep, only), schema)


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    return rows.where("q >= 0").withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= n)


def _block(index: VectorIndex, rows: list) -> _Queries:
    dim = index.centers.shape[1]
    x = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        if r["direction"] and dim:
            x[i] = r["direction"]
    along = x @ index.centers.T
    aside = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - along**2, 0.0) + _SLACK**2)
    return _Queries([r["id"] for r in rows], np.array([r["case"] for r in rows], dtype=object), x, along, aside)


def nearest(index: VectorIndex, queries: DataFrame, id_col: str, case_type: str, vectors: str, n: int = 20, exact: bool = True, probes: int = 8) -> DataFrame:
    """(query_id, id, similarity, direction, candidate_rank, keep): the ``n`` most similar
    candidates of each query's case type, itself left out, ties by id; as ``top_candidates``
    of ``similarities`` gives, without meeting every candidate.

    ``exact`` gives just that; else the ``probes`` cells that the query points to most are
    searched and no others. Queries without an id or case type find nothing. They are a
    stated set, which goes to all tasks in blocks of ``BLOCK_BYTES``; a block reads the cells
    that it probes, and, if exact, the index once. Results are written to the shared folder.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    spark = queries.sparkSession
    asked = queries.where(F.col(id_col).isNotNull() & F.col(case_type).isNotNull())
    asked = written(asked.select(F.col(id_col).alias("id"), F.col(case_type).cast("string").alias("case"), weighted_direction(F.col(vectors)).alias("direction")), "vector_queries")
    size = asked.agg(F.sum(F.greatest(F.size("direction"), F.lit(0)) * 8 + 64)).first()[0] or 0
    blocks, out = -(-int(size) // BLOCK_BYTES) or 1, None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        if not rows and out is not None:
            continue
        q = _block(index, rows)
        first = np.argsort(-q.along, axis=1, kind="stable")[:, :probes]
        only = np.zeros(q.along.shape, bool)
        np.put_along_axis(only, first, True, axis=1)
        cells = [int(k) for k in np.flatnonzero(only.any(axis=0))]
        floors = np.full(len(rows), -np.inf)
        found = _ranked(_scan(index, index.table.where(F.col("cell").isin(cells)), q, n, floors, only), n)
        if exact:
            for r in found.where(F.col("candidate_rank") == n).select("q", "similarity").collect():
                floors[r["q"]] = r["similarity"]
            found = _ranked(_scan(index, index.table, q, n, floors), n)
        ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], StructType([StructField("q", IntegerType()), StructField("query_id", asked.schema["id"].dataType)]))
        part = written(found.join(F.broadcast(ids), "q").drop("q"), "nearest")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)
