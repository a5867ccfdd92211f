"""Retrieval of examples: ranked-set similarity, top-k, diversity, balanced sets."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import dot, weighted_direction
from ..sources.shared import discarded, written
from .curate import global_rank

#: Candidates kept by relevance, picks per class, greatest similarity of two picks.
TOP_N, PER_CLASS, MAX_SIMILARITY = 20, 1, 0.9
#: Bytes of query vectors that go to all tasks at once, about.
BLOCK_BYTES = 64 << 20
#: The greatest cut of ranks that Spark makes before a shuffle (windowGroupLimitThreshold).
CUT_AHEAD = 1000
#: Rows that the candidates of a pool are packed into, about, and least and most candidates of one.
PACKS, LEAST_PACK, MOST_PACK = 64, 64, 4096
#: Where all rows are queries: packs of queries of a pool, about, and most queries of one; bytes of
#: a pack of candidates, and pairs that are scored at once, about; rows of packs that a worker gets.
QUERY_PACKS, MOST_QUERIES, PACK_BYTES, TILE, _BATCH = 32, 1024, 2 << 20, 1 << 16, 8


def directions(df: DataFrame, vectors: str, out: str = "direction") -> DataFrame:
    """``df`` with one vector per row whose dot products are set-to-set similarities."""
    return df.withColumn(out, weighted_direction(F.col(vectors)))


def rank_sentences(df: DataFrame, group: str, score: str, idx: str = "idx", out: str = "rank") -> DataFrame:
    """Rank from 1 within a document, ties by the later sentence."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(idx).desc())))


def pool_places(df: DataFrame, case_type: str, label: str, id_col: str, out: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1 by id, in its pool of one case type and label;
    null groups are pools too. Pools are few and large, so rows are dealt out by ranges of
    the whole order, and a pool's first place is taken off."""
    order = [F.col(c).asc_nulls_first() for c in (case_type, label, id_col)]
    ranked = global_rank(df, order)
    starts = ranked.groupBy(F.col(case_type).alias("_case"), F.col(label).alias("_label")).agg(F.min("_rank").alias("_first"))
    joined = ranked.join(starts, F.col(case_type).eqNullSafe(F.col("_case")) & F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn(out, F.col("_rank") - F.col("_first") + 1).drop("_case", "_label", "_first", "_rank")


def candidate_pools(df: DataFrame, case_type: str, label: str, id_col: str, cap: int) -> DataFrame:
    """(case_type, label, ids, ranks): the first ``cap`` candidates of each pool by id, with
    ranks from 1; null groups are kept. Whole pools are rows: see ``pool_places``. Each task
    cuts its part of a pool to ``cap`` before rows move, up to ``CUT_AHEAD``."""
    if cap <= CUT_AHEAD:
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(case_type, label).orderBy(id_col)))
    else:
        ranked = pool_places(df, case_type, label, id_col, "_r").withColumn("_r", F.col("_r").cast("int"))
    ranked = ranked.where(F.col("_r") <= cap)
    pool = F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col(id_col).alias("id"))))
    out = ranked.groupBy(case_type, label).agg(pool.alias("_p"))
    return out.select(case_type, label, F.transform("_p", lambda x: x["id"]).alias("ids"), F.transform("_p", lambda x: x["_r"]).alias("ranks"))


def similarities(queries: DataFrame, candidates: DataFrame, id_col: str, case_type: str, vectors: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, similarity, keep): every query with every candidate of its case type
    but itself. Each side is reduced to one direction per row first, so that a pair costs
    one dot product. Queries are a stated set: they go to all tasks in blocks whose vectors
    take ``BLOCK_BYTES`` at most, so that candidates stay where they are, and the cut to the
    best that follows is made there first."""
    q = directions(queries, vectors).select(F.col(id_col).alias("query_id"), F.col(case_type).alias("_case"), F.col("direction").alias("_q"))
    c = directions(candidates, vectors).select(id_col, F.col(case_type).alias("_case"), F.col("direction").alias("_c"), *keep)
    size = q.agg(F.sum(F.size("_q") * F.lit(8) + F.lit(64))).first()[0] or 0
    blocks = -(-int(size) // BLOCK_BYTES) or 1
    part = lambda i: q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
    pairs = c.join(F.broadcast(part(0)), "_case")
    for i in range(1, blocks):
        pairs = pairs.unionByName(c.join(F.broadcast(part(i)), "_case"))
    pairs = pairs.where(F.col("query_id") != F.col(id_col))
    score = F.when((F.size("_q") > 0) & (F.size("_c") > 0), dot(F.col("_q"), F.col("_c"))).otherwise(F.lit(0.0))
    return pairs.select("query_id", id_col, score.alias("similarity"), F.col("_c").alias("direction"), *keep)


def top_candidates(pairs: DataFrame, id_col: str, n: int = TOP_N, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The ``n`` most similar candidates per query (and class), as candidate_rank from 1;
    ties by id."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    order = Window.partitionBy(*by).orderBy(F.col("similarity").desc(), F.col(id_col).asc())
    return pairs.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= n)


def _dealt(candidates: DataFrame, pool: list[str], size: Column) -> DataFrame:
    """``candidates`` with their ``_pack`` of their pool, of about ``size`` (by ``_many``) rows."""
    counts = candidates.groupBy(*[F.col(p).alias(f"_of{i}") for i, p in enumerate(pool)]).agg(F.count("*").alias("_many"))
    same = [F.col(p).eqNullSafe(F.col(f"_of{i}")) for i, p in enumerate(pool)]
    at = F.pmod(F.xxhash64("_row"), F.ceil(F.col("_many") / size)).alias("_pack")
    return candidates.join(counts, on=same).select(*[candidates[c] for c in candidates.columns], at)


def _packs(candidates: DataFrame, pool: list[str]) -> DataFrame:
    """(pool, _members: array of (_row, _id, _c)): the candidates (_row, _id, _c) of each pool in rows
    of many."""
    size = F.least(F.lit(MOST_PACK), F.greatest(F.lit(LEAST_PACK), F.ceil(F.col("_many") / PACKS)))
    dealt = _dealt(candidates, pool, size)
    return dealt.groupBy(*pool, "_pack").agg(F.collect_list(F.struct("_row", "_id", "_c")).alias("_members")).drop("_pack")


def best_candidates(queries: DataFrame, candidates: DataFrame, id_col: str, case_type: str, vectors: str, n: int = TOP_N, group: str | None = None, direction: bool = True) -> DataFrame:
    """``top_candidates`` of ``similarities``: (query_id, id, similarity, group, candidate_rank), the
    ``n`` most similar per query (and ``group``, a column of the candidates), with their
    ``direction`` if asked.

    Every pair is compared, but none is a row: candidates are packed into about ``PACKS`` rows
    a pool, each query takes the ``n`` best of a pack, and only those, without vectors, are
    sorted. So the memory of a task follows packs and queries, not pairs. Candidates'
    directions are written to the shared folder.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    q = directions(queries, vectors).select(F.col(id_col).alias("query_id"), F.col(case_type).alias("_case"), F.col("direction").alias("_q"))
    of = [] if group is None else [F.col(group).alias("_group")]
    c = directions(candidates, vectors).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(case_type).alias("_case"), F.col("direction").alias("_c"), *of)
    c = written(c, "directions")
    by = ["_group"] if of else []
    packs = _packs(c.where("_case is not null"), ["_case", *by])
    size = q.agg(F.sum(F.size("_q") * F.lit(8) + F.lit(64))).first()[0] or 0
    blocks = -(-int(size) // BLOCK_BYTES) or 1

    def score(m):
        both = F.when((F.size("_q") > 0) & (F.size(m["_c"]) > 0), dot(F.col("_q"), m["_c"])).otherwise(F.lit(0.0))
        return F.struct(m["_row"].alias("_row"), m["_id"].alias("_id"), both.alias("similarity"))

    def key(m):
        """Greatest first, as a descending order has them: not a number, numbers, null; then by id."""
        s = m["similarity"]
        return F.struct(F.when(F.isnan(s), 0).when(s.isNull(), 2).otherwise(1).alias("_k"), (-s).alias("_s"), m["_id"].alias("_id"), m["_row"].alias("_row"), s.alias("similarity"))

    def part(i: int) -> DataFrame:
        some = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        others = F.filter("_members", lambda m: m["_id"] != F.col("query_id"))
        best = F.slice(F.array_sort(F.transform(F.transform(others, score), key)), 1, n)
        met = packs.join(F.broadcast(some), "_case").select("query_id", *by, F.explode(best).alias("_m"))
        return met.select("query_id", *by, F.col("_m._row").alias("_row"), F.col("_m._id").alias("_id"), F.col("_m.similarity").alias("similarity"))

    met = part(0)
    for i in range(1, blocks):
        met = met.unionByName(part(i))
    top = top_candidates(met, "_id", n, ("query_id", *by))
    if direction:
        top = top.join(c.select("_row", F.col("_c").alias("direction")), "_row")
    named = [F.col("_group").alias(group)] if of else []
    return top.select("query_id", F.col("_id").alias(id_col), "similarity", *named, "candidate_rank", *(["direction"] if direction else []))


@contextlib.contextmanager
def _few_rows(spark: SparkSession):
    """Rows are whole packs: hand workers few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, _BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass(frozen=True)
class _Pack:
    """Rows of a pack: ids, entries by place, lengths, and which have a null entry."""

    ids: np.ndarray
    x: np.ndarray
    lengths: np.ndarray
    holes: np.ndarray


def _pack(rows: pa.StructArray) -> _Pack:
    ids, vectors = rows.field("_id").to_numpy(zero_copy_only=False), rows.field("_c")
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat, dim = vectors.flatten(), int(lengths.max(initial=0))
    if len(flat) == len(ids) * dim and flat.null_count == 0:
        x, holes = flat.to_numpy(zero_copy_only=False).reshape(len(ids), dim), np.zeros(len(ids), bool)
    else:
        x, holes = np.zeros((len(ids), dim)), np.zeros(len(ids), bool)
        for i, v in enumerate(vectors.to_pylist()):
            holes[i] = any(e is None for e in v or ())
            x[i, : lengths[i]] = [0.0 if e is None else e for e in v or ()]
    return _Pack(ids, np.ascontiguousarray(x.T), lengths, holes)


def _scores(q: _Pack, c: _Pack, some: slice) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of ``some`` queries to all candidates, and which are null. Products are added
    one after the other, as ``dot`` does, so equal rows have equal similarities wherever they
    stand."""
    part = q.x[:, some]
    out = np.zeros((part.shape[1], len(c.ids)))
    product = np.empty_like(out)
    with np.errstate(all="ignore"):
        for a, b in zip(part, c.x):
            np.multiply(a[:, None], b, out=product)
            out += product
    lengths = q.lengths[some, None]
    both = (lengths > 0) & (c.lengths > 0)
    out[~both] = 0.0
    return out, both & ((lengths != c.lengths) | q.holes[some, None] | c.holes)


#: Of each of a few pairs: the query's place in its pack, the group's code, the order of its
#: similarity (not a number, numbers, null), the similarity, the candidate's id.
_Hits = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _first(hits: _Hits, n: int) -> _Hits:
    """The ``n`` first of each query and group, greatest similarity first, ties by id."""
    query, code, kind, score, ids = hits
    ranks = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((ranks, np.where(kind == 1, -score, 0.0), kind, code, query))
    query, code = query[order], code[order]
    new = np.r_[True, (np.diff(query) != 0) | (np.diff(code) != 0)][: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    order = order[place < n]
    return tuple(h[order] for h in hits)


def _hits(q: _Pack, c: _Pack, codes: np.ndarray, n: int) -> Iterator[_Hits]:
    """The ``n`` best candidates of each query and group in a pack, tile by tile."""
    order = np.argsort(codes, kind="stable")
    c, codes = _Pack(c.ids[order], np.ascontiguousarray(c.x[:, order]), c.lengths[order], c.holes[order]), codes[order]
    starts = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
    step = max(1, TILE // len(codes))
    for at in range(0, len(q.ids), step):
        score, null = _scores(q, c, slice(at, at + step))
        other = q.ids[at : at + step, None] != c.ids
        nan = np.isnan(score) & ~null
        reach = np.where(nan, np.inf, np.where(null | ~other, -np.inf, score))
        found = other
        for low, high in zip(starts, [*starts[1:], len(codes)]):
            if high - low > n:
                part = reach[:, low:high]
                found[:, low:high] &= part >= np.partition(part, high - low - n, axis=1)[:, high - low - n, None]
        i, j = np.nonzero(found)
        kind = np.where(nan[i, j], 0, np.where(null[i, j], 2, 1))
        yield _first((i + at, codes[j], kind, score[i, j], c.ids[j]), n)


def _met(n: int, grouped: bool, kinds: Callable[[pa.Schema], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_case, _pack, _queries, _members) to (query_id, _group, _id, similarity): the ``n`` best of each
    query and group. A pack of queries meets its packs of candidates one after the other and
    keeps the best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        now, q, best, types = None, None, None, None

        def rows() -> pa.RecordBatch:
            query, code, kind, score, ids = best
            names = list(known)
            columns = [pa.array(q.ids[query], types[0]), pa.array(ids, types[0]), pa.array(score, pa.float64(), mask=kind == 2)]
            columns += [pa.array([names[k] for k in code], types[1])] if grouped else []
            return pa.RecordBatch.from_arrays(columns, ["query_id", "_id", "similarity", *(["_group"] if grouped else [])])

        for batch in batches:
            types = kinds(batch.schema)
            for i in range(batch.num_rows):
                key = batch.column("_case")[i].as_py(), batch.column("_pack")[i].as_py()
                if key != now:
                    if best is not None:
                        yield rows()
                    now, q, best = key, _pack(batch.column("_queries")[i].values), None
                members = batch.column("_members")[i].values
                groups = members.field("_group").to_pylist() if grouped else [None] * len(members)
                codes = np.array([known.setdefault(g, len(known)) for g in groups], np.int64)
                for hits in _hits(q, _pack(members), codes, n):
                    best = hits if best is None else tuple(np.concatenate(p) for p in zip(best, hits))
                best = _first(best, n)
        if best is not None:
            yield rows()

    return run


def best_of_all(rows: DataFrame, id_col: str, case_type: str, vectors: str, n: int = TOP_N, group: str | None = None) -> DataFrame:
    """``best_candidates`` of all ``rows`` for each of them, without directions: (query_id, id,
    similarity, group, candidate_rank).

    Every pair of a case type is compared, so time is quadratic. Nothing else is: queries
    and candidates are packed, and tasks meet a pack of queries with one pack of candidates
    after the other, keeping each query's ``n`` best. Candidates go to all tasks in blocks of
    ``BLOCK_BYTES``, one block at a time; a block's results are written to the shared folder.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    spark = rows.sparkSession
    of = [] if group is None else [F.col(group).alias("_group")]
    by = ["_group"] if of else []
    some = directions(rows.where(F.col(id_col).isNotNull() & F.col(case_type).isNotNull()), vectors)
    c = written(some.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(case_type).alias("_case"), F.col("direction").alias("_c"), *of), "directions")
    each = F.greatest(F.coalesce(F.size("_c"), F.lit(0)), F.lit(0)).cast("long") * 8 + 64
    size, longest = (int(x or 0) for x in c.agg(F.sum(each), F.max(each)).first())
    blocks, tasks = -(-size // BLOCK_BYTES) or 1, max(4 * spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    few = F.least(F.lit(MOST_QUERIES), F.greatest(F.lit(LEAST_PACK), F.ceil(F.col("_many") / QUERY_PACKS)))
    asked = _dealt(c, ["_case"], few).repartition(tasks, "_case", "_pack")
    asked = asked.groupBy("_case", "_pack").agg(F.collect_list(F.struct("_id", "_c")).alias("_queries"))
    dealt = _dealt(c, ["_case"], F.lit(max(1, PACK_BYTES // max(longest, 1)))).withColumnRenamed("_pack", "_of")
    kind = c.schema["_id"].dataType
    schema = StructType([StructField("query_id", kind), StructField("_id", kind), StructField("similarity", DoubleType()), *[StructField(g, c.schema[g].dataType) for g in by]])

    def kinds(found: pa.Schema) -> tuple:
        members = found.field("_members").type.value_type
        return tuple(members.field(f).type for f in ("_id", *by))

    parts = []
    for i in range(blocks):
        block = dealt if blocks == 1 else dealt.where(F.pmod("_of", F.lit(blocks)) == i)
        block = block.groupBy("_case", "_of").agg(F.collect_list(F.struct("_id", "_c", *by)).alias("_members"))
        pairs = asked.join(F.broadcast(block), "_case").select("_case", "_pack", "_queries", "_members")
        with _few_rows(spark):
            parts.append(written(pairs.mapInArrow(_met(n, bool(of), kinds), schema), "best"))
    discarded(spark, c)
    met = parts[0]
    for part in parts[1:]:
        met = met.unionByName(part)
    top = top_candidates(met, "_id", n, ("query_id", *by))
    named = [F.col("_group").alias(group)] if of else []
    return top.select("query_id", F.col("_id").alias(id_col), "similarity", *named, "candidate_rank")


def diverse(ranked: DataFrame, id_col: str, k: int = PER_CLASS, most: float | None = MAX_SIMILARITY, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Greedy picks per group: the best candidate, then the next whose similarity to every
    pick is below ``most``, until there are ``k``; diversity_rank from 1.

    ``ranked`` is as of ``top_candidates`` (at most n rows a group), so a group is one
    sorted array that a fold walks.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    row = F.struct("candidate_rank", F.col(id_col).alias("id"), "similarity", *(["direction"] if most is not None else []))
    groups = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = groups.schema["rows"].dataType.simpleString()

    def step(acc, x):
        ok = F.size(acc) < k
        if most is not None:
            ok = ok & ~F.exists(acc, lambda p: dot(p["direction"], x["direction"]) >= most)
        return F.when(ok, F.concat(acc, F.array(x))).otherwise(acc)

    picked = groups.select(*by, F.posexplode(F.aggregate("rows", F.expr(f"cast(array() as {kind})"), step)).alias("_i", "p"))
    return picked.select(*by, F.col("p.id").alias(id_col), F.col("p.similarity").alias("similarity"), (F.col("_i") + 1).alias("diversity_rank"))


def few_shot(pairs: DataFrame, id_col: str, label: str, top_n: int = TOP_N, per_class: int = PER_CLASS, most: float | None = MAX_SIMILARITY, balanced: bool = True, max_total: int | None = None) -> DataFrame:
    """(query_id, label, id, similarity, few_shot_rank): diverse picks of each class; if
    ``balanced``, every class that has any is cut to the smallest one's number; by class,
    then similarity, at most ``max_total`` per query, which numbers anew over all."""
    return few_shot_of(top_candidates(pairs, id_col, top_n, ("query_id", label)), id_col, label, per_class, most, balanced, max_total)


def few_shot_of(ranked: DataFrame, id_col: str, label: str, per_class: int = PER_CLASS, most: float | None = MAX_SIMILARITY, balanced: bool = True, max_total: int | None = None) -> DataFrame:
    """``few_shot`` of candidates that are ranked per query and class."""
    by = ("query_id", label)
    picks = diverse(ranked, id_col, per_class, most, by)
    picks = picks.withColumnRenamed("diversity_rank", "few_shot_rank")
    if balanced:
        least = picks.groupBy(*by).agg(F.max("few_shot_rank").alias("_n")).groupBy("query_id").agg(F.min("_n").alias("_least"))
        picks = picks.join(least, "query_id").where(F.col("few_shot_rank") <= F.col("_least")).drop("_least")
    if max_total is None:
        return picks
    order = Window.partitionBy("query_id").orderBy(F.col(label).asc_nulls_last(), F.col("similarity").desc(), F.col(id_col))
    numbered = picks.withColumn("_r", F.row_number().over(order))
    over = F.max("_r").over(Window.partitionBy("query_id")) > max_total
    return numbered.withColumn("few_shot_rank", F.when(over, F.col("_r")).otherwise(F.col("few_shot_rank"))).where(F.col("_r") <= max_total).drop("_r")


def few_shot_map(picks: DataFrame, label: str, keep: tuple[str, ...]) -> DataFrame:
    """(query_id, examples): all picks of a query, by class and rank."""
    row = F.struct(F.col(label).alias("_l"), "few_shot_rank", *keep)
    return picks.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_e")).select("query_id", F.transform("_e", lambda x: F.struct(x["_l"].alias(label), x["few_shot_rank"].alias("few_shot_rank"), *[x[c].alias(c) for c in keep])).alias("examples"))
