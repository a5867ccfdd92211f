"""Sentence attributions: Shapley values by masking, their tables and tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .curate import exact_quantiles
from .sentences import anchor_groups

MASK = "..."


def attribution_long(df: DataFrame, keep: tuple[str, ...] = ("case_id",), sentences: str = "sentences", values: str = "values", predicted: str = "predicted_class") -> DataFrame:
    """(keep, sentence_idx, sentence_text, value of the predicted class, all values): one row
    per sentence. ``values`` has one array over the classes per sentence."""
    zipped = F.arrays_zip(F.col(sentences).alias("s"), F.col(values).alias("v"))
    rows = df.select(*keep, predicted, F.posexplode(zipped).alias("sentence_idx", "z"))
    return rows.select(*keep, predicted, "sentence_idx", F.col("z.s").alias("sentence_text"), F.get("z.v", F.col(predicted).cast("int")).alias("shap_value"), F.col("z.v").alias("shap_values_all_classes"))


def mean_by_sentence(long: DataFrame, case: str = "case_id", text: str = "sentence_text", value: str = "shap_value", fold_case: bool = False) -> DataFrame:
    """(case, key, n, mean): mean value of a sentence that occurs more than once in a case,
    by its trimmed text, in lower case if asked."""
    key = F.trim(text)
    return long.groupBy(case, (F.lower(key) if fold_case else key).alias("key")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def top_both_ways(means: DataFrame, n: int, case: str = "case_id", value: str = "mean", key: str = "key") -> DataFrame:
    """(…, sign, rank): the ``n`` largest positive and ``n`` least negative values a case."""
    up = Window.partitionBy(case).orderBy(F.col(value).desc(), F.col(key))
    down = Window.partitionBy(case).orderBy(F.col(value).asc(), F.col(key))
    pos = means.where(F.col(value) > 0).withColumn("rank", F.row_number().over(up)).withColumn("sign", F.lit("positive"))
    neg = means.where(F.col(value) < 0).withColumn("rank", F.row_number().over(down)).withColumn("sign", F.lit("negative"))
    return pos.unionByName(neg).where(F.col("rank") <= n)


def top_absolute(long: DataFrame, n: int, case: str = "case_id", value: str = "shap_value", idx: str = "sentence_idx") -> DataFrame:
    order = Window.partitionBy(case).orderBy(F.abs(value).desc(), F.col(idx))
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def case_summary(long: DataFrame, case: str = "case_id", value: str = "shap_value", base: str = "base_value", prediction: str = "prediction") -> DataFrame:
    """Per case: n, total, ends of the base value, share of positive values, and how far
    base and total together are from the prediction."""
    out = long.groupBy(case).agg(F.count("*").alias("n_sentences"), F.sum(value).alias("total"), F.min(base).alias("base_min"), F.max(base).alias("base_max"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("share_positive"), F.first(prediction).alias("prediction"))
    return out.withColumn("error", F.col("base_min") + F.col("total") - F.col("prediction"))


def spread(long: DataFrame, by: str, value: str = "shap_value") -> DataFrame:
    """Per group: mean, median, sample deviation, mean and largest size, share positive."""
    rest = long.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg(F.abs(value)).alias("mean_abs"), F.max(F.abs(value)).alias("max_abs"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("share_positive"))
    middle = exact_quantiles(long, by, value, (0.5,)).select(F.col(by).alias("_by"), F.col("quantiles")[0].alias("median"))
    return rest.join(middle, rest[by].eqNullSafe(middle["_by"]), "left").drop("_by")


def length_effect(cases: DataFrame, size: str = "n_sentences", mass: str = "total") -> DataFrame:
    """(r, at_shortest, at_longest): correlation of document size and total, and the total
    of the shortest and longest document (ties by the total)."""
    return cases.agg(F.corr(F.col(size).cast("double"), F.col(mass).cast("double")).alias("r"), F.min_by(mass, F.struct(size, mass)).alias("at_shortest"), F.max_by(mass, F.struct(size, mass)).alias("at_longest"))


def anchor_enrichment(long: DataFrame, n: int = 20, case: str = "case_id", text: str = "sentence_text") -> DataFrame:
    """(case, rate, top_rate): share of sentences with an anchor, of all and of the ``n``
    largest values; a pooled row has a null case."""
    marked = long.withColumn("_a", F.when(F.size(anchor_groups(F.col(text))) > 0, 1.0).otherwise(0.0))
    order = Window.partitionBy(case).orderBy(F.abs("shap_value").desc(), F.col("sentence_idx"))
    ranked = marked.withColumn("_r", F.row_number().over(order))
    rates = [F.avg("_a").alias("rate"), F.avg(F.when(F.col("_r") <= n, F.col("_a"))).alias("top_rate")]
    each = ranked.groupBy(case).agg(*rates)
    return each.unionByName(ranked.agg(*rates).withColumn(case, F.lit(None).cast(each.schema[case].dataType)).select(*each.columns))


def axiom_gaps(long: DataFrame, values: str = "shap_values_all_classes") -> DataFrame:
    """(most): the largest distance from 0 of the sum of a sentence's values over classes."""
    return long.agg(F.max(F.abs(F.aggregate(values, F.lit(0.0), lambda s, x: s + x))).alias("most"))


# Values -------------------------------------------------------------------------------------


def shapley_rows(predict: Callable[[list[str]], np.ndarray], budget: int = 200, exact_up_to: int = 7, seed: int = 7):
    """mapInPandas function over (case_id, sentences): (case_id, base, prediction, values).

    Documents of up to ``exact_up_to`` sentences have exact Shapley values from all subsets;
    longer ones a mean over permutations of sentences, in pairs of a permutation and its
    reverse, within ``budget`` evaluations (one permutation at least). Left-out sentences
    become ``...``. Values of a document sum to prediction minus base.
    """

    def mask(sentences: list[str], on: np.ndarray) -> str:
        return " ".join(s if keep else MASK for s, keep in zip(sentences, on, strict=True))

    def explain(sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(sentences)
        if n <= exact_up_to:
            sets = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
            scores = np.asarray(predict([mask(sentences, s) for s in sets]), float)
            values = np.zeros((n, scores.shape[1]))
            fact = np.cumprod([1.0, *range(1, n + 1)])
            for k in range(1 << n):
                size = bin(k).count("1")
                for i in range(n):
                    if not k >> i & 1:
                        values[i] += fact[size] * fact[n - size - 1] / fact[n] * (scores[k | 1 << i] - scores[k])
            return scores[0], scores[-1], values
        rng = np.random.default_rng(seed)
        rounds = max(1, budget // (2 * n))
        values = 0.0
        for _ in range(rounds):
            order = rng.permutation(n)
            for way in (order, order[::-1]):
                sets = np.zeros((n + 1, n), bool)
                for at, i in enumerate(way):
                    sets[at + 1 :, i] = True
                scores = np.asarray(predict([mask(sentences, s) for s in sets]), float)
                step = np.zeros((n, scores.shape[1]))
                step[way] = scores[1:] - scores[:-1]
                values = values + step / (2 * rounds)
        return scores[0], scores[-1], values

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for case, sentences in zip(part["case_id"], part["sentences"], strict=True):
                base, full, values = explain(list(sentences) if sentences is not None else [])
                rows.append((case, base.tolist(), full.tolist(), [v.tolist() for v in values]))
            yield pd.DataFrame(rows, columns=["case_id", "base", "prediction", "values"])

    return run


def shapley(df: DataFrame, predict: Callable[[list[str]], np.ndarray], case_type: str = "string", **how) -> DataFrame:
    """Shapley values of ``df`` (case_id, sentences) under a text classifier."""
    schema = f"case_id {case_type}, base array<double>, prediction array<double>, values array<array<double>>"
    return df.select("case_id", "sentences").mapInPandas(shapley_rows(predict, **how), schema)


def html_report(df: DataFrame, case: str = "case_id", sentences: str = "sentences", value: str = "shown") -> Column:
    """A self-contained page per case: each sentence in a span coloured by its value."""
    from ..functions.text import span_colour

    escape = lambda s: F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    most = F.coalesce(F.array_max(F.transform(value, F.abs)), F.lit(0.0))
    spans = F.zip_with(sentences, value, lambda s, v: F.concat(F.lit('<span style="background:'), span_colour(v, most), F.lit('" title="'), F.format_number(v, 6), F.lit('">'), escape(s), F.lit("</span>")))
    return F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), escape(F.col(case).cast("string")), F.lit("</title></head><body><p>"), F.array_join(spans, " "), F.lit("</p></body></html>"))
