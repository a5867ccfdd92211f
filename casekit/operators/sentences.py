"""Sentence scores and constrained selection of summary sentences."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import let, sentence_tokens, sentences
from ..functions.vectors import TINY
from ..vocabulary import ANCHOR_WEIGHTS, ANCHORS, QUERIES
from .batches import in_batches

#: Weights of query, centroid and anchors, and the least share of anchored sentences.
WEIGHTS, MIN_ANCHOR_RATIO = (0.7, 0.3, 0.35), 0.6


def _has_anchor(low: Column, group: str) -> Column:
    found = F.lit(False)
    for p in ANCHORS[group]:
        found = found | F.contains(low, F.lit(p))
    return found


def anchor_groups(sentence: Column) -> Column:
    """Names of the anchor groups with a phrase in the sentence, in any case."""
    return let(F.lower(sentence), lambda low: F.filter(F.array(*[F.when(_has_anchor(low, g), F.lit(g)) for g in ANCHORS]), lambda x: x.isNotNull()))


def anchor_score(sentence: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Sum of the weights of the sentence's groups over the sum of all; unknown groups and
    negative weights raise."""
    weights = ANCHOR_WEIGHTS if weights is None else weights
    bad = [k for k, w in weights.items() if k not in ANCHORS or w < 0]
    if bad:
        raise ValueError(f"unknown group or negative weight: {bad}")
    total = float(sum(weights.values()))
    if not total:
        return F.lit(0.0)
    weigh = lambda low: sum((F.when(_has_anchor(low, g), float(weights[g])).otherwise(0.0) for g in ANCHORS if g in weights), F.lit(0.0))
    return F.coalesce(let(F.lower(sentence), weigh), F.lit(0.0)) / F.lit(total)


def sentence_table(df: DataFrame, id_col: str, text_col: str, min_chars: int = 8) -> DataFrame:
    """(id, idx, sentence), idx from 0."""
    return df.select(id_col, F.posexplode(sentences(F.col(text_col), min_chars)).alias("idx", "sentence"))


# Encoder ------------------------------------------------------------------------------------


def hash_encoder(dim: int = 64, seed: int = 3) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without a model: signed counts of hashed words, unit length."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode(), seed)
                row[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def encoded(text: Column, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> Column:
    """array<float> of each text; ``encoder`` makes the encoding function, once a worker
    task, which then takes up to ``batch`` texts at a time, fewer where memory does not do.
    Null counts as empty."""

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for part in parts:
            texts = ["" if t is None else t for t in part]
            rows = in_batches(encode, texts, batch)
            yield pd.Series([v.astype(np.float32) for v in rows], index=part.index, dtype="object")

    return run(text)


def encoded_all(texts: Column, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> Column:
    """array<array<float>> of an array of texts, as ``encoded``: a row's texts stay together."""

    @pandas_udf("array<array<float>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for part in parts:
            lists = [[] if some is None else ["" if x is None else x for x in some] for some in part]
            flat = [x for some in lists for x in some]
            rows = [v.astype(np.float32) for v in in_batches(encode, flat, batch)]
            ends = np.cumsum([0, *map(len, lists)])
            yield pd.Series([rows[a:b] for a, b in pairwise(ends.tolist())], index=part.index, dtype="object")

    return run(texts)


def query_vector(case_type: str, encode: Callable[[list[str]], np.ndarray]) -> list[float]:
    """Mean vector of the case type's query templates."""
    return np.asarray(encode(list(QUERIES[case_type]))).mean(0).tolist()


# Scores and selection -----------------------------------------------------------------------


def fused_dot(a: Sequence[float], b: Sequence[float]) -> float:
    """Sum of products, each added before it is rounded, as ``list_dot_product`` of the SQL
    does: vectors that point the same way differ in the last bit of their cosines by the
    order of roundings, and with it in rank."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total = math.fma(x, y, total)
    return total


def fused_cosines(vectors: Column, query: Sequence[float]) -> Column:
    """Struct of the arrays ``query`` and ``centre``: the cosines of each of ``vectors`` with
    the query and with their mean; norms are at least 1e-9. Null for a null vector or one of
    another length."""

    def size(v: Sequence[float]) -> float:
        return max(math.sqrt(fused_dot(v, v)), TINY)

    def mean(some: list) -> list[float] | None:
        if not some or any(v is None for v in some):
            return None
        total = np.zeros(max(map(len, some)))
        for v in some:
            total[: len(v)] += v
        return (total / len(some)).tolist()

    def cosines(some: list, target: list[float] | None) -> list[float | None]:
        if target is None:
            return [None] * len(some)
        whole = size(target)
        return [None if v is None or len(v) != len(target) else fused_dot(v, target) / (size(v) * whole) for v in some]

    @pandas_udf("struct<query:array<double>,centre:array<double>>")
    def run(many: pd.Series) -> pd.DataFrame:
        rows = []
        for vs in many:
            some = None if vs is None else [None if v is None else v.tolist() for v in vs]
            rows.append((None, None) if some is None else (cosines(some, query), cosines(some, mean(some))))
        return pd.DataFrame(rows, columns=["query", "centre"], dtype="object")

    return run(vectors)


def with_scores(df: DataFrame, query: Sequence[float], sentence_col: str = "sentences", vector_col: str = "vectors", weights: Sequence[float] = WEIGHTS, out: str = "scores") -> DataFrame:
    """``df`` with one score per sentence: cosine with the query, cosine with the document's
    centroid and anchor score, by ``weights`` scaled to sum to 1 (negative or all zero raise).
    Arrays of sentences and vectors must be of one length."""
    if len(weights) != 3 or min(weights) < 0 or not sum(weights):
        raise ValueError("three weights are needed, none negative and not all zero")
    q, c, a = (w / sum(weights) for w in weights)
    found = df.withColumn("_near", fused_cosines(F.col(vector_col), [float(x) for x in query]))
    paired = F.arrays_zip(F.col("_near.query").alias("q"), F.col("_near.centre").alias("c"), F.col(sentence_col).alias("s"))
    score = F.transform(paired, lambda p: q * p["q"] + c * p["c"] + a * anchor_score(p["s"]))
    return found.withColumn(out, score).drop("_near")


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def with_selection(
    df: DataFrame,
    sentence_col: str = "sentences",
    score_col: str = "scores",
    top_k: int | None = None,
    max_tokens: int | None = None,
    min_anchor_ratio: float = MIN_ANCHOR_RATIO,
    max_per_group: Mapping[str, int] | None = None,
    max_anchorless: int | None = None,
    out: str = "selected",
) -> DataFrame:
    """``df`` with the places (from 0, ascending) of the selected sentences.

    Sentences are taken by score, ties by the later place. Those with an anchor come
    first; if fewer than ``top_k`` were taken, or it is not given, all others follow, those
    without an anchor up to ``max_anchorless`` (by default ``int(top_k * (1 -
    min_anchor_ratio))``, or no bound without ``top_k``). A sentence that would pass the
    token budget or a group's cap is passed over and blocks none after it. Both walks are
    one fold each over the ranked array: no rows move.
    """
    if top_k is not None and top_k < 1 or max_tokens is not None and max_tokens < 1:
        raise ValueError("top_k and max_tokens must be 1 or more")
    if not 0 <= min_anchor_ratio <= 1:
        raise ValueError("min_anchor_ratio must be between 0 and 1")
    caps = dict(max_per_group or {})
    if set(caps) - set(ANCHORS) or any(v < 0 for v in caps.values()) or (max_anchorless or 0) < 0:
        raise ValueError("unknown group or negative cap")
    bare = max_anchorless if max_anchorless is not None else 1_000_000_000 if top_k is None else int(top_k * (1 - min_anchor_ratio))
    groups = list(ANCHORS)
    item = F.transform(
        F.arrays_zip(F.col(score_col).alias("score"), F.sequence(F.lit(0), F.size(score_col) - 1).alias("idx"), F.col(sentence_col).alias("s")),
        lambda x: F.struct((-x["score"]).alias("rank"), (-x["idx"]).alias("neg"), sentence_tokens(x["s"]).alias("tokens"), anchor_groups(x["s"]).alias("groups")),
    )
    ranked = F.when(F.size(score_col) > 0, F.array_sort(item)).otherwise(F.expr("cast(array() as array<struct<rank:double,neg:int,tokens:int,groups:array<string>>>)"))
    zero = F.struct(_empty("int").alias("sel"), F.lit(0).alias("tokens"), F.lit(0).alias("bare"), F.array(*[F.lit(0)] * len(groups)).alias("counts"))

    def walk(anchored_only: bool):
        def step(acc: Column, x: Column) -> Column:
            idx, none = -x["neg"], F.size(x["groups"]) == 0
            ok = ~F.array_contains(acc["sel"], idx)
            if top_k is not None:
                ok = ok & (F.size(acc["sel"]) < top_k)
            if max_tokens is not None:
                ok = ok & (acc["tokens"] + x["tokens"] <= max_tokens)
            ok = ok & (~none if anchored_only else (~none | (acc["bare"] < bare)))
            for i, g in enumerate(groups):
                if g in caps:
                    ok = ok & ~(F.array_contains(x["groups"], g) & (acc["counts"][i] >= caps[g]))
            counts = F.array(*[acc["counts"][i] + F.when(F.array_contains(x["groups"], g), 1).otherwise(0) for i, g in enumerate(groups)])
            taken = F.struct(F.concat(acc["sel"], F.array(idx)).alias("sel"), (acc["tokens"] + x["tokens"]).alias("tokens"), (acc["bare"] + F.when(none, 1).otherwise(0)).alias("bare"), counts.alias("counts"))
            return F.when(ok, taken).otherwise(acc)

        return step

    first = df.withColumn("_ranked", ranked).withColumn("_state", F.aggregate("_ranked", zero, walk(True)))
    second = first.withColumn("_state", F.aggregate("_ranked", F.col("_state"), walk(False)))
    return second.withColumn(out, F.array_sort(F.col("_state.sel"))).drop("_ranked", "_state")


def summary_text(sentence_col: str = "sentences", selected_col: str = "selected") -> Column:
    """The selected sentences in document order, space-joined."""
    return F.array_join(F.transform(F.col(selected_col), lambda i: F.get(F.col(sentence_col), i)), " ")


def sentence_frame(df: DataFrame, id_col: str, text_col: str, case_type: str, encoder: Callable[[], Callable] = hash_encoder, min_chars: int = 8, **limits) -> DataFrame:
    """``df`` with sentences, vectors, scores, selected and summary_text: split, encode,
    score and select. No rows move; ``id_col`` may repeat."""
    split = df.withColumn("sentences", sentences(F.col(text_col), min_chars))
    made = split.withColumn("vectors", encoded_all(F.col("sentences"), encoder))
    scored = with_scores(made, query_vector(case_type, encoder()))
    return with_selection(scored, **limits).withColumn("summary_text", summary_text())


def enriched(df: DataFrame, classes: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``df`` (with sentences, scores, selected) with ranks, retention and the case's class.

    ``sentence_rank_order`` lists places by score, ``sentence_ranks`` each sentence's rank
    from 1; a case without a class raises.
    """
    order = F.transform(F.array_sort(F.transform(F.arrays_zip("scores", F.sequence(F.lit(0), F.size("scores") - 1).alias("idx")), lambda x: F.struct((-x["scores"]).alias("a"), (-x["idx"]).alias("b")))), lambda x: -x["b"])
    ranks = F.transform("scores", lambda _, i: F.array_position("sentence_rank_order", i).cast("int"))
    kept = F.size("selected")
    out = df.withColumn("sentence_rank_order", F.when(F.size("scores") > 0, order).otherwise(_empty("int"))).withColumn("sentence_ranks", ranks)
    out = out.withColumns({"sentence_count": F.size("sentences"), "selected_count": kept, "selected_percentage": F.when(F.size("sentences") > 0, 100.0 * kept / F.size("sentences")).otherwise(0.0)})
    named = classes.select(id_col, F.col(label_col).alias("decision_class"))
    missing = F.raise_error(F.concat(F.lit("no class for "), F.col(id_col).cast("string"))).cast("string")
    return out.join(named, id_col, "left").withColumn("decision_class", F.coalesce("decision_class", missing))
