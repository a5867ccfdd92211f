"""Classification metrics, bootstrap intervals, group comparison."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import written

METRICS = ("macro_f1", "mcc")
#: Groups of at most so many values, one of them, have exact p values, if the other is not
#: larger than what their product allows.
SMALL, MOST_PRODUCT = 8, 1 << 16


def confusion_counts(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y_true, y_pred, n): cells that occur; rows with a null label are left out."""
    rows = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull())
    return rows.groupBy(*keys, F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: Sequence[int]) -> DataFrame:
    """(y_true, one column pred_<label> each) with 0 in empty cells, one row per label."""
    spark = df.sparkSession
    cells = confusion_counts(df, true, pred)
    grid = spark.createDataFrame([(x,) for x in labels], "y_true int")
    cols = [F.coalesce(F.sum(F.when(F.col("y_pred") == x, F.col("n"))), F.lit(0)).cast("long").alias(f"pred_{x}") for x in labels]
    return grid.join(cells, "y_true", "left").groupBy("y_true").agg(*cols)


def class_metrics(cells: DataFrame, labels: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, label, support, precision, recall, f1) from cells; 0 where undefined."""
    parts = []
    for x in labels:
        t, p = F.col("y_true") == x, F.col("y_pred") == x
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
        parts += [total(t & p).alias(f"tp_{x}"), total(t).alias(f"t_{x}"), total(p).alias(f"p_{x}")]
    wide = cells.groupBy(*keys).agg(*parts)
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"tp_{x}").alias("tp"), F.col(f"t_{x}").alias("t"), F.col(f"p_{x}").alias("p")) for x in labels])
    long = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    return long.select(*keys, "label", t.alias("support"), ratio(tp, p).alias("precision"), ratio(tp, t).alias("recall"), ratio(2 * tp, t + p).alias("f1"))


def overall_metrics(cells: DataFrame, labels: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_samples, n_correct, accuracy, macro_f1, mcc) from cells.

    MCC is (c s - sum p t) / sqrt((s² - sum p²) (s² - sum t²)), 0 where that is undefined.
    """
    aggs = [F.sum("n").cast("long").alias("s"), F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0)).cast("long").alias("c")]
    for x in labels:
        for name, cond in ((f"t{x}", F.col("y_true") == x), (f"p{x}", F.col("y_pred") == x), (f"h{x}", (F.col("y_true") == x) & (F.col("y_pred") == x))):
            aggs.append(F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double").alias(name))
    wide = cells.groupBy(*keys).agg(*aggs)
    add = lambda cols: sum(cols[1:], cols[0])
    f1 = [F.when(F.col(f"t{x}") + F.col(f"p{x}") > 0, 2 * F.col(f"h{x}") / (F.col(f"t{x}") + F.col(f"p{x}"))).otherwise(0.0) for x in labels]
    s, c = F.col("s").cast("double"), F.col("c").cast("double")
    cross = add([F.col(f"t{x}") * F.col(f"p{x}") for x in labels])
    under = (s * s - add([F.col(f"p{x}") * F.col(f"p{x}") for x in labels])) * (s * s - add([F.col(f"t{x}") * F.col(f"t{x}") for x in labels]))
    mcc = F.when(under > 0, (c * s - cross) / F.sqrt(under)).otherwise(F.lit(0.0))
    return wide.select(*keys, F.col("s").alias("n_samples"), F.col("c").alias("n_correct"), (c / s).alias("accuracy"), (add(f1) / len(labels)).alias("macro_f1"), mcc.alias("mcc"))


def binomial_quantile(n: int, p: float, u: float) -> int:
    """The least k whose distribution function, of k successes in ``n`` draws of chance ``p``,
    reaches ``u``.

    Masses are built up from the mode by their ratios, as far as twelve deviations to either
    side: what lies beyond is below what doubles can tell.
    """
    if n <= 0 or p <= 0 or p >= 1:
        return n if p >= 1 and n > 0 else 0
    reach = 12 * math.sqrt(n * p * (1 - p)) + 12
    low, high = max(0, math.floor(n * p - reach)), min(n, math.ceil(n * p + reach))
    k = np.arange(low, high, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1) * (p / (1 - p))))])
    masses = np.exp(logs - logs.max())
    return min(high, low + int(np.searchsorted(np.cumsum(masses) / masses.sum(), u)))


def _uniform(*key) -> float:
    """A number between 0 and 1 that the key decides."""
    return (int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def bootstrap_cells(df: DataFrame, true: str, pred: str, n_resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(b, y_true, y_pred, n): cells of resamples, each class drawn with replacement to its
    size.

    As metrics depend on cells alone, a class's draws are one multinomial count over its
    cells: binomial counts of one cell after the other, given what is left. Each is the
    quantile of a number that seed, resample, class and cell decide, so that it is the same
    everywhere. Rows are counted once; a resample costs a few arrays, as long as the root of
    a class's size. Only the cells (classes squared numbers) come to the driver.
    """
    cells: dict = {}
    for true_label, pred_label, n in confusion_counts(df, true, pred).orderBy("y_true", "y_pred").collect():
        cells.setdefault(true_label, []).append((pred_label, n))
    spark = df.sparkSession
    kind = df.schema[true].dataType.simpleString(), df.schema[pred].dataType.simpleString()
    schema = f"b long, y_true {kind[0]}, y_pred {kind[1]}, n long"
    if not cells:
        return spark.createDataFrame([], schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for b in part["id"].tolist():
                for label, own in cells.items():
                    left, open_ = sum(n for _, n in own), sum(n for _, n in own)
                    for guess, n in own:
                        k = left if n == open_ else binomial_quantile(left, n / open_, _uniform(seed, b, label, guess))
                        left, open_ = left - k, open_ - n
                        if k:
                            rows.append((b, label, guess, k))
            yield pd.DataFrame(rows, columns=["b", "y_true", "y_pred", "n"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, n_resamples, 1, min(parts, n_resamples)).mapInPandas(run, schema)


def bootstrap_intervals(df: DataFrame, true: str, pred: str, labels: Sequence[int], n_resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """(metric, label, point, ci_lower, ci_upper): point values and exact percentiles over
    the resamples of macro F1 and MCC (label null) and of each class's metrics."""
    low = (1 - confidence) / 2

    def long(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        total = overall_metrics(cells, labels, keys).select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(None).cast("int").alias("label"), F.col(m).alias("value")) for m in METRICS])).alias("r"))
        each = class_metrics(cells, labels, keys).select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("label"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")])).alias("r"))
        return total.unionByName(each).select(*keys, "r.*")

    point = long(confusion_counts(df, true, pred), []).withColumnRenamed("value", "point")
    spread = long(bootstrap_cells(df, true, pred, n_resamples, seed), ["b"]).groupBy("metric", "label").agg(F.percentile("value", F.array(F.lit(low), F.lit(1 - low))).alias("q"))
    q = spread.select(F.col("metric").alias("m"), F.col("label").alias("l"), F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"))
    return point.join(q, (point.metric == q.m) & point.label.eqNullSafe(q.l)).select("metric", "label", "point", "ci_lower", "ci_upper")


def metrics_wide(long: DataFrame, names: dict[int, str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: {metric}_point, _ci_lower, _ci_upper, and with the class's
    name {metric}_{CLASS}_point and so on. ``long`` is as of ``bootstrap_intervals``."""
    cols = []
    for metric in METRICS:
        for part in ("point", "ci_lower", "ci_upper"):
            cols.append(F.max(F.when((F.col("metric") == metric) & F.col("label").isNull(), F.col(part))).alias(f"{metric}_{part}"))
    for metric in ("precision", "recall", "f1"):
        for code, name in names.items():
            for part in ("point", "ci_lower", "ci_upper"):
                cols.append(F.max(F.when((F.col("metric") == metric) & (F.col("label") == code), F.col(part))).alias(f"{metric}_{name}_{part}"))
    return long.groupBy(*keys).agg(*cols)


def mann_whitney(df: DataFrame, group: Column, value: str) -> DataFrame:
    """(n1, n2, u, auc, z, p_value) of the values where ``group`` holds against the others:
    U = R1 - n1 (n1 + 1) / 2 with mean ranks, AUC = U / (n1 n2), and a two-sided normal
    approximation with tie and continuity correction.

    Values are aggregated to their counts first; mean ranks come from the running count
    over distinct values, numbered by ranges as in ``global_rank``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"), F.count_if(group).alias("n1"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counts.repartitionByRange(parts, "v").withColumn("_part", F.spark_partition_id()), "values")
    sums = dealt.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect()
    starts, at = {}, 0
    for part, n in sums:
        starts[part] = at
        at += n
    add = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("_part")] if starts else F.lit(0)
    upto = Window.partitionBy("_part").orderBy("v")
    ranked = dealt.withColumn("rank", add + F.sum("n").over(upto) - F.col("n") + (F.col("n") + 1) / 2.0)
    total = ranked.agg(F.sum("n1").cast("double").alias("n1"), F.sum(F.col("n") - F.col("n1")).cast("double").alias("n2"), F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    m = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((m + 1) - F.col("ties") / (m * (m - 1))))
    z = (F.abs(u - n1 * n2 / 2) - 0.5) / spread
    out = total.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), (u / (n1 * n2)).alias("auc"), F.greatest(z, F.lit(0.0)).alias("z"))
    return out.withColumn("p_value", normal_two_sided(F.col("z")))


def rank_sum_counts(m: int, n: int) -> list[int]:
    """How many of the ways to choose ``m`` of ``m + n`` ranks have U = 0, 1, … m n.

    The coefficients of the product of (1 - q^(n+i)) / (1 - q^i) over i up to m, in integers.
    """
    out = np.zeros(m * n + 1, dtype=object)
    out[0] = 1
    for i in range(1, m + 1):
        if n + i <= m * n:
            out[n + i :] = out[n + i :] - out[: m * n + 1 - n - i]
        for at in range(min(i, m * n + 1)):
            out[at::i] = np.cumsum(out[at::i])
    return [int(v) for v in out]


def exact_two_sided(n1: int, n2: int, u: float) -> float:
    """P(U as far from its mean as ``u``, to either side), without ties."""
    counts = rank_sum_counts(min(n1, n2), max(n1, n2))
    beyond = sum(counts[int(max(u, n1 * n2 - u)) :])
    return min(1.0, 2 * beyond / sum(counts))


def mann_whitney_by(df: DataFrame, keys: Sequence[str], group: Column, value: str) -> DataFrame:
    """(keys, n1, n2, u, auc, z, p_value, exact) of each group of rows with equal ``keys``, as
    ``mann_whitney`` of it, but with the exact distribution of U where one side has at most
    ``SMALL`` values, the sides' product is at most ``MOST_PRODUCT`` and no values tie.

    Values are aggregated to their counts; running counts are within a key, so a key's
    distinct values meet in one task: for one very large table take ``mann_whitney``. Null
    values are left out, null keys are a key; a group without both sides has null results.
    """
    named = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), group.alias("g"))
    counts = named.groupBy(*keys, "v").agg(F.count("*").alias("n"), F.count_if("g").alias("n1"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))
    ranked = counts.withColumn("rank", upto - F.col("n") + (F.col("n") + 1) / 2.0)
    cubes = (F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")
    total = ranked.groupBy(*keys).agg(F.sum("n1").cast("double").alias("n1"), F.sum(F.col("n") - F.col("n1")).cast("double").alias("n2"), F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum(cubes).alias("ties"))
    n1, n2, both = F.col("n1"), F.col("n2"), (F.col("n1") > 0) & (F.col("n2") > 0)
    u, m = F.col("r1") - n1 * (n1 + 1) / 2, n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((m + 1) - F.try_divide(F.col("ties"), m * (m - 1))))
    z = F.greatest(F.coalesce(F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, spread), F.lit(0.0)), F.lit(0.0))
    small = (F.least(n1, n2) <= SMALL) & (n1 * n2 <= MOST_PRODUCT) & (F.col("ties") == 0)
    out = total.select(*keys, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), F.when(both, u).alias("u"), F.when(both, u / F.nullif(n1 * n2, F.lit(0.0))).alias("auc"), F.when(both, z).alias("z"), F.coalesce(both & small, F.lit(False)).alias("exact"))

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, x: pd.Series, use: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known.setdefault((i, j, k), exact_two_sided(int(i), int(j), k)) if e else None for i, j, k, e in zip(a, b, x, use, strict=True)], dtype="float64")

    exact = out.withColumn("_p", tail("n1", "n2", "u", "exact"))
    return exact.select(*keys, "n1", "n2", "u", "auc", "z", F.coalesce(F.col("_p"), F.when(F.col("z").isNotNull(), normal_two_sided(F.col("z")))).alias("p_value"), "exact")


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution beyond ``z`` (0 or more), by the
    series of erf below 3 and the continued fraction of erfc above."""
    x = z / F.lit(2.0**0.5)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("t"), x.alias("s")), lambda a, k: F.struct((-a["t"] * x * x / k).alias("t"), (a["s"] + (-a["t"] * x * x / k) / (2 * k + 1)).alias("s")), lambda a: F.lit(1.0) - a["s"] * F.lit(2 / 3.141592653589793**0.5))
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), F.lit(0.0), lambda a, k: (k / 2.0) / (x + a))
    tail = F.exp(-x * x) / F.lit(3.141592653589793**0.5) / (x + fraction)
    return F.when(z < 3, series).otherwise(tail)


def fit_diagnosis(metrics: DataFrame) -> DataFrame:
    """(gap_f1, gap_mcc, verdict) from rows (split, macro_f1, mcc) of train and gold: under
    if the training MCC is within 0.05 of 0 and the F1 gap under 0.10, over if that gap is
    above 0.20, else inconclusive; null where a split is missing."""
    of = lambda split, m: F.max(F.when(F.col("split") == split, F.col(m)))
    wide = metrics.agg(of("train", "macro_f1").alias("tf"), of("train", "mcc").alias("tm"), of("gold", "macro_f1").alias("gf"), of("gold", "mcc").alias("gm"))
    gap = F.col("tf") - F.col("gf")
    verdict = F.when(gap.isNull(), None).when((F.abs("tm") < 0.05) & (gap < 0.10), "under").when(gap > 0.20, "over").otherwise("inconclusive")
    return wide.select(gap.alias("gap_f1"), (F.col("tm") - F.col("gm")).alias("gap_mcc"), verdict.alias("verdict"))


def baseline_summary(df: DataFrame, true: str, scores: str) -> DataFrame:
    """(n, majority_share, confidence_min, _mean, _max, _std): the share of the largest true
    class, and the greatest score's spread (of the whole population)."""
    top = F.array_max(scores)
    most = df.where(F.col(true).isNotNull()).groupBy(true).count().agg((F.max("count") / F.sum("count")).alias("share")).first()[0]
    aggs = [F.min(top).alias("confidence_min"), F.avg(top).alias("confidence_mean"), F.max(top).alias("confidence_max"), F.stddev_pop(top).alias("confidence_std")]
    return df.agg(F.count("*").alias("n"), F.lit(most).cast("double").alias("majority_share"), *aggs)
