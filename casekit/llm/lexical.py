"""Ranked lexical search by block-max pruning.

Consecutive documents form a block of a forward index: terms, postings by document, and for
each term the largest impact and the number of documents that it has in the block. A query's
bound on a block adds up its terms' largest impacts. Blocks with the highest bounds give each
query a first threshold; then every task takes its blocks by falling bound and scores them
until the bound drops below the query's threshold, which rises as it goes. A block whose
bound reaches the threshold is always scored, so the result is that of scoring everything.

All scores are integers; logarithms, in doubles, only give the terms' weights.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._common import bound_batches, discard, drop_worker_caches, materialize, new_path

#: Maximal runs of letters, digits and whatever is not ASCII, with A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for the bytes of UTF-8: what parts terms becomes a space.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A block is closed once it has so many documents, or so many words.
BLOCK_DOCS, BLOCK_WORDS = 64, 1 << 16
#: Blocks that give a query its first threshold.
SEEDS = 4
#: Terms of the queries that are searched for at once; more are searched for in groups.
GROUP_TERMS = 1 << 18
#: Blocks that a worker holds at a time.
_BATCH = 64
_SALTS = 64


def terms_of(data: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return data.translate(_BYTES).split() if data else []


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray | int, n_docs: int, n_terms: int):
    """m of documents of ``n`` terms, in a corpus of ``n_docs`` documents and ``n_terms`` terms."""
    return 25 + 75 * n * n_docs // n_terms


def impact(tf: np.ndarray | int, m: np.ndarray | int):
    """What a term that occurs ``tf`` times adds, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_worker_caches()
    docs = terms = 0
    for batch in batches:
        for data in _texts(batch.column(0)):
            n = len(terms_of(data))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


def _block(number: int, ids: list, found: list[list[bytes]], n_docs: int, n_terms: int, id_type: pa.DataType) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in found], np.int64)
    coded = pa.array([t for terms in found for t in terms], pa.binary()).dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    keys, tf = np.unique(np.repeat(np.arange(len(found)), sizes) * len(names) + codes, return_counts=True)
    doc, term = keys // len(names), keys % len(names)
    m = length_factor(sizes, n_docs, n_terms)
    top = np.zeros(len(names), np.int32)
    np.maximum.at(top, term, impact(tf.astype(np.int64), m[doc]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.array([b" ".join(names)], pa.binary()), pa.array([top.tobytes()], pa.binary()),
            pa.array([np.bincount(term, minlength=len(names)).astype(np.int32).tobytes()], pa.binary()),
            pa.array([ids], pa.list_(id_type)), pa.array([m.tobytes()], pa.binary()),
            pa.array([np.bincount(doc, minlength=len(found)).astype(np.int32).tobytes()], pa.binary()),
            pa.array([term.astype(np.int32).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary()),
        ],
        ["block", "terms", "tops", "dfs", "ids", "m", "sizes", "term", "tf"],
    )


def _index_rows(n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        drop_worker_caches()
        number, ids, found, words, id_type = TaskContext.get().partitionId() << 32, [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for i, data in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                terms = terms_of(data)
                if not terms:
                    continue
                ids.append(i)
                found.append(terms)
                words += len(terms)
                if len(ids) >= BLOCK_DOCS or words >= BLOCK_WORDS:
                    yield _block(number, ids, found, n_docs, n_terms, id_type)
                    number, ids, found, words = number + 1, [], [], 0
        if ids:
            yield _block(number, ids, found, n_docs, n_terms, id_type)

    return run


@dataclass(frozen=True)
class LexicalIndex:
    """A forward index in blocks, in the shared folder, with the corpus's counts."""

    path: str
    n_docs: int
    n_terms: int
    schema: str

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Index all rows of ``docs`` that have a term; each is a document, also if ids repeat.

    Blocks are runs of rows as Spark reads them, so nothing is shuffled, and neither a hot
    term nor a group of copies gathers in one task. Corpus counts take a pass of their own.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_docs, n_terms = rows.select("text").mapInArrow(_count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block long, terms binary, tops binary, dfs binary, ids array<{kind}>, m binary, sizes binary, term binary, tf binary"
    path = new_path(spark, "lexical_index")
    blocks = rows.mapInArrow(_index_rows(n_docs, n_terms), schema)
    blocks.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return LexicalIndex(path, n_docs, n_terms, schema)


@dataclass(frozen=True)
class _Queries:
    """A group of queries: numbers, distinct terms, and each query's terms and weights, one
    query after the other."""

    numbers: list[int]
    vocabulary: list[bytes]
    term: np.ndarray
    repeats: np.ndarray
    starts: np.ndarray

    def places(self, batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
        """For each block of ``batch``: its terms' places in the vocabulary, -1 for others."""
        listed = pa.array(self.vocabulary, pa.binary())
        for blob in batch.column(column).to_pylist():
            at = pc.index_in(pa.array(blob.split(b" "), pa.binary()), value_set=listed)
            yield pc.fill_null(at, -1).to_numpy()


def _group(rows: list) -> _Queries:
    vocabulary, term, repeats, starts = {}, [], [], []
    for row in rows:
        counts: dict[bytes, int] = {}
        for t in row["terms"]:
            counts[t.encode()] = counts.get(t.encode(), 0) + 1
        starts.append(len(term))
        term += [vocabulary.setdefault(t, len(vocabulary)) for t in counts]
        repeats += counts.values()
    return _Queries([r["q"] for r in rows], list(vocabulary), np.array(term, np.int64), np.array(repeats, np.int64), np.array(starts, np.int64))


def _frequencies(queries: _Queries) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(terms, dfs) of blocks to (place, df): documents that hold each of the queries' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        total = np.zeros(len(queries.vocabulary) + 1, np.int64)
        for batch in batches:
            for at, dfs in zip(queries.places(batch, 0), batch.column(1).to_pylist()):
                total[at] += np.frombuffer(dfs, np.int32)  # the last place takes all others
                total[-1] = 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["place", "df"])

    return run


def _bound(queries: _Queries, weights: np.ndarray, at: np.ndarray, tops: bytes) -> np.ndarray:
    """The queries' bounds on a block."""
    dense = np.zeros(len(queries.vocabulary) + 1, np.int64)
    dense[at] = np.frombuffer(tops, np.int32)
    return np.add.reduceat(dense[queries.term] * weights, queries.starts)


def _best_blocks(queries: _Queries, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, terms, tops) to (q, block, bound): a task's blocks of highest bound a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        bounds = blocks = np.zeros((0, len(queries.numbers)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.array([_bound(queries, weights, at, tops) for at, tops in zip(queries.places(batch, 1), batch.column(2).to_pylist())])
            bounds = np.concatenate([bounds, new])
            blocks = np.concatenate([blocks, np.repeat(batch.column(0).to_numpy()[:, None], len(queries.numbers), axis=1)])
            order = np.argsort(-bounds, axis=0, kind="stable")[:SEEDS]
            bounds, blocks = np.take_along_axis(bounds, order, 0), np.take_along_axis(blocks, order, 0)
        rank, query = np.nonzero(bounds > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(blocks[rank, query]), pa.array(bounds[rank, query])], ["q", "block", "bound"])

    return run


class _Scorer:
    """The scores of a block's documents, which it puts in a matrix once it is asked."""

    def __init__(self, row: dict, at: np.ndarray):
        self.row, self.at, self.matrix = row, at, None

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if self.matrix is None:
            sizes = np.frombuffer(self.row["sizes"], np.int32)
            doc, term = np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(self.row["term"], np.int32)
            tf, m = np.frombuffer(self.row["tf"], np.int32).astype(np.int64), np.frombuffer(self.row["m"], np.int64)
            asked = self.at[term] >= 0
            self.places, local = np.unique(self.at[term[asked]], return_inverse=True)
            self.matrix = np.zeros((len(sizes), len(self.places)), np.int64)
            self.matrix[doc[asked], local] = impact(tf[asked], m[doc[asked]])
        if not len(self.places):
            return np.zeros(len(self.matrix), np.int64)
        where = np.minimum(np.searchsorted(self.places, terms), len(self.places) - 1)
        there = self.places[where] == terms
        return self.matrix[:, where[there]] @ weights[there]


def _key(pair: tuple[int, object]) -> tuple:
    """Highest score first, then by id, null ids first."""
    return -pair[0], pair[1] is not None, pair[1]


def _top_documents(queries: _Queries, weights: np.ndarray, floors: np.ndarray, k: int, only: dict[int, list[int]] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks to (q, id, score): a task's ``k`` best documents of each query, those whose score
    is under the query's floor left out. With ``only``, blocks are scored for the queries
    named there and for no other."""
    ends = np.append(queries.starts[1:], len(queries.term))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        least, best, kind = np.maximum(floors, 1), [[] for _ in queries.numbers], None
        for batch in batches:
            names = batch.schema.names
            kind = batch.column(names.index("ids")).type
            if not batch.num_rows:
                continue
            rows, places = batch.to_pylist(), list(queries.places(batch, names.index("terms")))
            bounds = np.array([_bound(queries, weights, at, r["tops"]) for at, r in zip(places, rows)])
            if only is not None:
                asked = np.zeros(bounds.shape, bool)
                for b, r in enumerate(rows):
                    asked[b, only.get(r["block"], [])] = True
                bounds = np.where(asked, bounds, 0)
            scorers = [_Scorer(r, at) for r, at in zip(rows, places)]
            for q in np.flatnonzero((bounds >= least).any(axis=0)):
                part = slice(queries.starts[q], ends[q])
                for b in np.argsort(-bounds[:, q], kind="stable"):
                    if bounds[b, q] < least[q]:
                        break
                    scores = scorers[b].scores(queries.term[part], weights[part])
                    some = np.flatnonzero(scores >= least[q])
                    if len(some):
                        ids = rows[b]["ids"]
                        best[q] = sorted(best[q] + [(int(scores[d]), ids[d]) for d in some], key=_key)[:k]
                        if len(best[q]) == k:
                            least[q] = max(least[q], best[q][-1][0])
        if kind is not None:
            flat = [(q, i, s) for q, found in enumerate(best) for s, i in found]
            columns = list(zip(*flat)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind.value_type), pa.array(columns[2], pa.int64())], ["q", "id", "score"])

    return run


def _first(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each ``q``, with ``rank``; first within shares, as many tasks
    give rows for each query."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q", salt).orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


@contextlib.contextmanager
def _few_rows(spark: SparkSession):
    """Rows are whole blocks: hand workers few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, _BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _search_group(spark: SparkSession, index: LexicalIndex, queries: _Queries, k: int) -> DataFrame:
    blocks, kind = index.blocks(spark), index.schema.split("ids array<", 1)[1].split(">, m binary")[0]
    found = blocks.select("terms", "dfs").mapInArrow(_frequencies(queries), "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in found:
        df[r["place"]] = r["df"]
    each = np.array([weight(index.n_docs, int(d)) for d in df], np.int64)
    weights = each[queries.term] * queries.repeats
    seeds = _first(blocks.select("block", "terms", "tops").mapInArrow(_best_blocks(queries, weights), "q int, block long, bound long"), SEEDS, F.desc("bound"), "block").collect()
    only: dict[int, list[int]] = {}
    for r in seeds:
        only.setdefault(r["block"], []).append(r["q"])
    floors, schema = np.zeros(len(queries.numbers), np.int64), f"q int, id {kind}, score long"
    some = blocks.where(F.col("block").isin(list(only))).mapInArrow(_top_documents(queries, weights, floors, k, only=only), schema)
    for r in _first(some, k, F.desc("score"), "id").where(F.col("rank") == k).collect():
        floors[r["q"]] = r["score"]
    out = blocks.mapInArrow(_top_documents(queries, weights, floors, k), schema)
    numbers = F.array(*[F.lit(n).cast("long") for n in queries.numbers])
    ranked = _first(out, k, F.desc("score"), "id")
    return ranked.select(F.get(numbers, F.col("q")).alias("q"), "id", "score", "rank")


def search(index: LexicalIndex, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """The ``k`` best documents of each row of ``items``: item, ``rank`` (int, from 1), id, ``score``.

    Documents with score 0 are no results; equal scores come by ascending id (null first),
    so an item without terms, or whose terms no document has, gives none. Items are searched
    for in groups of ``GROUP_TERMS`` terms, each of which reads the index four times, twice
    for its terms and maxima only. What a group sends to all tasks, and gets from them at the
    driver, is bounded by its terms. Repeated items, and items without an id, are searched
    for one by one. Results are written to the shared folder.
    """
    spark = items.sparkSession
    terms = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    asked = items.select(F.col(item_col).alias("item"), F.coalesce(terms, F.expr("cast(array() as array<string>)")).alias("terms"))
    asked = materialize(asked.where(F.size("terms") > 0).withColumn("q", F.monotonically_increasing_id()), "queries")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups, out = -(-total // GROUP_TERMS), []
    kind = index.schema.split("ids array<", 1)[1].split(">, m binary")[0]
    if not index.n_docs:
        groups = 0
    with _few_rows(spark):
        for g in range(groups):
            rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g).select("q", "terms").collect()
            if rows:
                out.append(materialize(_search_group(spark, index, _group(rows), k), "hits"))
    hits = spark.createDataFrame([], f"q long, id {kind}, score long, rank int") if not out else out[0]
    for more in out[1:]:
        hits = hits.unionByName(more)
    return hits.join(asked.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def drop_index(spark: SparkSession, index: LexicalIndex) -> None:
    """Delete the index's files; only once nothing reads it any more."""
    df = index.blocks(spark)
    df._casekit_path = index.path
    discard(df)
