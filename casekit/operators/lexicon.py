"""An encoder learned from a corpus: positive pointwise mutual information of words that
occur near each other, its leading singular vectors, and sentences as weighted means.

Counts are summed in tasks before they move. The matrix stays on Spark as rows; a product
with a block of vectors is one pass over it, and a few passes with random vectors give its
leading subspace. The driver holds the vocabulary and blocks of vocabulary times dimensions,
both of which are parameters and don't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import clean_basic, words
from ..sources.shared import discarded, written

#: Words of the vocabulary, entries of a vector, distance of words that count as near, least count.
VOCABULARY, DIM, NEAR, LEAST = 50_000, 100, 4, 5
#: Vectors beyond the dimension, and passes, of the random subspace.
MORE, PASSES = 10, 3
#: Weight of a word of share p in a sentence: RARE / (RARE + p).
RARE = 1e-3
#: Pairs that a task counts, at once and before it hands them on.
_HELD = 1 << 20


def vocabulary(df: DataFrame, text: Column, most: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """(word, n): the ``most`` most frequent words of cleaned texts that occur ``least`` times
    or more; ties by the word."""
    counts = df.select(F.explode(words(clean_basic(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


def _pairs(place: dict[str, int], near: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    v, names = len(place), pa.array(list(place), pa.string())

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        all_, which = np.unique(np.concatenate(keys), return_inverse=True)
        return all_, np.bincount(which, np.concatenate(counts), len(all_)).astype(np.int64)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys // v).astype(np.int32)), pa.array((keys % v).astype(np.int32)), pa.array(counts)], ["i", "j", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Put together once there are as many as are held: a copy for each text would take
        # time with the square of their number.
        keys, counts, held = [], [], 0
        for batch in batches:
            # Texts of up to so many pairs at once; words of two texts are not near.
            size = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(size), 0
            while at < batch.num_rows:
                first, before = at, ends[at] - size[at]
                at = max(at + 1, int(np.searchsorted(ends, before + _HELD // max(1, 2 * near), "right")))
                lists = batch.column(0).slice(first, at - first)
                ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(first, at), size[first:at])
                found = []
                for d in range(1, min(near, len(ids) - 1) + 1):
                    a, b = ids[:-d], ids[d:]
                    both = (a >= 0) & (b >= 0) & (text[:-d] == text[d:])
                    found += [a[both] * v + b[both], b[both] * v + a[both]]
                if found:
                    own, n = np.unique(np.concatenate(found), return_counts=True)
                    keys.append(own)
                    counts.append(n)
                    held += len(own)
                if held > _HELD:
                    own, n = summed(keys, counts)
                    if len(own) > _HELD // 2:
                        yield rows(own, n)
                        own, n = own[:0], n[:0]
                    keys, counts, held = [own], [n], len(own)
        if held:
            yield rows(*summed(keys, counts))

    return run


def near_counts(df: DataFrame, text: Column, known: list[str], near: int = NEAR) -> DataFrame:
    """(i, j, c): how often the i-th and j-th of the ``known`` words occur within ``near`` words
    of each other in a text, in either order; a pair of one word counts twice."""
    place = {w: i for i, w in enumerate(known)}
    tokens = df.select(words(clean_basic(text)).alias("t"))
    return tokens.mapInArrow(_pairs(place, near), "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c"))


def information(counts: DataFrame) -> DataFrame:
    """(i, j, v): positive pointwise mutual information, log(c total / (c_i c_j)) where above 0."""
    sums = counts.groupBy("i").agg(F.sum("c").alias("s"))
    total = F.lit(float(sums.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]))
    # One row for each word: small as the vocabulary is, and planned as Spark sees fit.
    both = counts.join(sums, "i").join(sums.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    value = F.log(F.col("c") * total / (F.col("s").cast("double") * F.col("t")))
    return both.select("i", "j", value.alias("v")).where("v > 0")


def _times(block: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (i, j, v) to (i, row): a task's part of the matrix times ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            i, j, v = (c.to_numpy() for c in batch.columns)
            order = np.argsort(i, kind="stable")
            i, part = i[order], v[order, None] * block[j[order]]
            starts = np.flatnonzero(np.r_[True, np.diff(i) > 0]) if len(i) else np.zeros(0, int)
            for at, row in zip(starts, np.add.reduceat(part, starts, axis=0) if len(i) else ()):
                sums[int(i[at])] = sums[int(i[at])] + row if int(i[at]) in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _product(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix of rows (i, j, v), dealt out by i, times ``block``."""
    out = np.zeros_like(block)
    for r in matrix.mapInArrow(_times(block), "i int, row array<double>").toArrow().to_batches():
        if r.num_rows:
            np.add.at(out, r.column(0).to_numpy(), r.column(1).flatten().to_numpy().reshape(r.num_rows, -1))
    return out


def leading(matrix: DataFrame, size: int, k: int, seed: int = 42, passes: int = PASSES, more: int = MORE) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``k`` largest singular values of the symmetric matrix of rows
    (i, j, v), ``size`` by ``size``, and their left vectors (columns).

    A random block of k + ``more`` vectors is multiplied ``passes`` + 2 times and made
    orthogonal in between; where it is as wide as the matrix, the result is exact.
    """
    width = min(size, k + more)
    q = np.linalg.qr(_product(matrix, np.random.default_rng(seed).normal(size=(size, width))))[0]
    for _ in range(passes):
        q = np.linalg.qr(_product(matrix, q))[0]
    left, values, _ = np.linalg.svd(_product(matrix, q).T @ q)
    return values[:k], (q @ left)[:, :k]


@dataclass(frozen=True)
class Lexicon:
    """Words, their vectors (rows), their shares of all words, and the singular values."""

    words: tuple[str, ...]
    vectors: np.ndarray
    shares: np.ndarray
    values: np.ndarray


def fit_lexicon(df: DataFrame, text_col: str, dim: int = DIM, most: int = VOCABULARY, near: int = NEAR, least: int = LEAST, seed: int = 42) -> Lexicon:
    """Word vectors from all texts of ``df``: singular vectors times roots of the values.

    Null and empty texts have no words. A corpus without a word that occurs ``least`` times
    gives an empty lexicon, which encodes every text as zeros.
    """
    text = F.col(text_col)
    known = vocabulary(df, text, most, least).collect()
    names, n = tuple(r["word"] for r in known), np.array([r["n"] for r in known], float)
    if not names:
        return Lexicon((), np.zeros((0, dim)), n, np.zeros(0))
    spark = df.sparkSession
    counts = written(near_counts(df, text, list(names), near), "near_counts")
    matrix = written(information(counts).repartition("i"), "information")
    values, left = leading(matrix, len(names), min(dim, len(names)), seed)
    discarded(spark, counts, matrix)
    vectors = np.zeros((len(names), dim))
    vectors[:, : len(values)] = left * np.sqrt(values)
    # Either sign is right: the largest entry of each direction is positive.
    at = np.abs(vectors).argmax(axis=0)
    vectors *= np.where(vectors[at, np.arange(dim)] < 0, -1.0, 1.0)
    return Lexicon(names, vectors, n / n.sum(), values)


def lexicon_encoder(lexicon: Lexicon) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Makes the function from texts to unit vectors, for ``sentences.encoded`` and the like:
    means of the words' vectors, rare words weighing more. Words are lower-case runs of
    letters, digits and underscores; a text without a known word is the zero vector."""
    import regex

    place = {w: i for i, w in enumerate(lexicon.words)}
    weighted = lexicon.vectors * (RARE / (RARE + lexicon.shares))[:, None]
    split = regex.compile(r"[\p{L}\p{N}_]+")

    def make() -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), weighted.shape[1]))
            for r, t in enumerate(texts):
                found = [place[w] for w in split.findall((t or "").lower()) if w in place]
                if found:
                    out[r] = weighted[found].sum(axis=0)
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(size > 0, size, 1.0)

        return encode

    return make


def save_lexicon(spark: SparkSession, lexicon: Lexicon, path: str) -> None:
    """Write ``lexicon`` under ``path``, a row for each word, replacing what is there."""
    n, dim = lexicon.vectors.shape
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, max(dim, 1), dtype=np.int32)[: n + 1]), pa.array(lexicon.vectors.ravel()))
    rows = pa.table({"place": pa.array(np.arange(n)), "word": pa.array(list(lexicon.words), pa.string()), "share": pa.array(lexicon.shares, pa.float64()), "vector": vectors})
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/words")
    spark.createDataFrame([(dim, [float(v) for v in lexicon.values])], "dim int, values array<double>").write.mode("overwrite").parquet(f"{path}/values")


def load_lexicon(spark: SparkSession, path: str) -> Lexicon:
    rows = spark.read.parquet(f"{path}/words").orderBy("place").toPandas()
    r = spark.read.parquet(f"{path}/values").first()
    vectors = np.stack(rows["vector"].to_list()) if len(rows) else np.zeros((0, r["dim"]))
    return Lexicon(tuple(rows["word"]), vectors, rows["share"].to_numpy(float), np.array(r["values"]))
