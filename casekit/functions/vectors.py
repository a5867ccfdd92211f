"""Expressions on array<double> vectors and class scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; norms are at least 1e-9, so that zero vectors have 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def unit(a: Column) -> Column:
    return let(F.greatest(norm(a), F.lit(TINY)), lambda size: F.transform(a, lambda x: x.cast("double") / size))


def add(a: Column, b: Column) -> Column:
    """Sum by position; a missing place counts as 0."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def rank_weights(n: Column) -> Column:
    """1/i over the sum of all 1/j, for i in 1..n; none for 0."""
    raw = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.lit(1.0) / i)).otherwise(F.expr("cast(array() as array<double>)"))
    return let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(r, lambda x: x / total)))


def weighted_direction(vectors: Column) -> Column:
    """Sum of the unit vectors of a ranked array of vectors by their rank weights: the dot
    product of two such directions is the set-to-set similarity of the two arrays."""
    parts = F.zip_with(vectors, rank_weights(F.size(vectors)), lambda v, w: F.transform(unit(v), lambda x: x * w))
    return F.aggregate(parts, F.expr("cast(array() as array<double>)"), lambda s, v: F.when(F.size(s) == 0, v).otherwise(add(s, v)))


def centroid(vectors: Column) -> Column:
    """Mean by position of an array of vectors."""
    total = F.aggregate(vectors, F.expr("cast(array() as array<double>)"), lambda s, v: F.when(F.size(s) == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(add(s, F.transform(v, lambda x: x.cast("double")))))
    return let(F.size(vectors), lambda n: F.transform(total, lambda x: x / n))


def parse_vector(text: Column) -> Column:
    """array<float> of a vector that was stored as JSON text."""
    return F.from_json(text, "array<float>")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(scores: Column) -> Column:
    raw = let(F.array_max(scores), lambda most: F.transform(scores, lambda x: F.exp(x - most)))
    return let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(r, lambda x: x / total)))


def argmax(scores: Column) -> Column:
    """Place (from 0) of the first greatest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def binary_scores(logit: Column) -> Column:
    """Probabilities of both classes of a binary logit."""
    return F.array(F.lit(1.0) - sigmoid(logit), sigmoid(logit))


def one_hot(code: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == code, 1.0).otherwise(0.0))


def smoothed(code: Column, n: int, share: float = 0.1) -> Column:
    """Probabilities of a label given as a code: 1 - share, and share spread over the
    others; an unknown label counts as class 0."""
    code = F.coalesce(code, F.lit(0))
    other = share / max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == code, 1.0 - share).otherwise(other))
