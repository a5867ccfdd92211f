"""Token windows, pooled vectors, features and models on them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let


SIZE, OVERLAP, SPECIAL, MOST_WINDOWS = 512, 128, 2, 16


def token_windows(tokens: Column, size: int = SIZE, overlap: int = OVERLAP, special: int = SPECIAL) -> Column:
    """Windows of ``size - special`` tokens that share ``overlap``; one empty window for no
    token. The last window ends with the text."""
    width = size - special
    if not 0 <= overlap < width:
        raise ValueError("the overlap must be smaller than a window")
    step = width - overlap

    def cut(all_: Column) -> Column:
        n = F.size(all_)
        count = F.when(n <= width, 1).otherwise(F.ceil((n - width) / step).cast("int") + 1)
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(all_, i * step + 1, F.lit(width)))

    return let(tokens, cut)


def spaced_subset(windows: Column, most: int = MOST_WINDOWS) -> Column:
    """All windows, or ``most`` equally spaced ones from the first to the last."""
    if most < 2:
        return F.slice(windows, 1, most)

    def pick(all_: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(all_, F.floor(i * (F.size(all_) - 1) / (most - 1)).cast("int")))
        return F.when(F.size(all_) > most, some).otherwise(all_)

    return let(windows, pick)


def pooled(df: DataFrame, id_col: str, vector_col: str, weight: Column | str | None = None, out: str = "embedding") -> DataFrame:
    """(id, window_count, out): mean of a document's vectors by position, weighted if asked.

    Tasks sum up their rows first, so that one vector per document and task moves. Weights
    are 0 or more, and a document's vectors have one length. Rows without a vector or a
    weight are counted, but no part of the mean; a document of only such rows has null.
    """
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    used = F.coalesce((F.size(vector_col) > 0) & (w != 0), F.lit(False))
    # What has no part is a group of its own, as a mean of nothing is an error.
    rows = df.select(
        id_col, used.alias("_used"), F.when(used, w).otherwise(F.lit(1.0)).alias("_w"),
        array_to_vector(F.when(used, F.col(vector_col).cast("array<double>")).otherwise(F.array(F.lit(0.0)))).alias("_v"),
    )
    means = rows.groupBy(id_col, "_used").agg(F.count("*").alias("_n"), Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m"))
    mean = F.first(F.when(F.col("_used"), vector_to_array("_m")), ignorenulls=True)
    return means.groupBy(id_col).agg(F.sum("_n").alias("window_count"), mean.alias(out))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows over classes times the class's rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total, k = counts.agg(F.sum("n"), F.count("*")).first()
    return counts.withColumn("weight", F.lit(float(total or 0)) / (F.lit(float(k or 1)) * F.col("n")))


def positive_weight(df: DataFrame, label: str) -> float:
    """Negatives over positives (at least 1)."""
    neg, pos = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return neg / max(pos, 1)


class ScaledPCA:
    """Standard scaling and the fewest principal components that explain a share of the
    variance, fitted on one table and applied to any."""

    def __init__(self, share: float = 0.95):
        self.share = share

    def fit(self, df: DataFrame, vector_col: str) -> ScaledPCA:
        rows = df.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("raw"))
        self.dim = rows.first()["raw"].size
        self.scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows)
        full = PCA(k=self.dim, inputCol="scaled", outputCol="pca").fit(self.scaler.transform(rows))
        reached = full.explainedVariance.toArray().cumsum()
        self.k = int((reached < self.share - 1e-12).sum()) + 1
        self.pca = full
        return self

    def save(self, path: str) -> None:
        """Write both models and the parameters under ``path``."""
        self.scaler.write().overwrite().save(f"{path}/scaler")
        self.pca.write().overwrite().save(f"{path}/pca")

    @classmethod
    def load(cls, path: str, share: float = 0.95) -> ScaledPCA:
        out = cls(share)
        out.scaler, out.pca = StandardScalerModel.load(f"{path}/scaler"), PCAModel.load(f"{path}/pca")
        out.dim = out.scaler.mean.size
        out.k = int((out.pca.explainedVariance.toArray().cumsum() < share - 1e-12).sum()) + 1
        return out

    def transform(self, df: DataFrame, vector_col: str, out: str = "features") -> DataFrame:
        made = df.withColumn("raw", array_to_vector(F.col(vector_col).cast("array<double>")))
        made = self.pca.transform(self.scaler.transform(made))
        return made.withColumn(out, F.slice(vector_to_array("pca"), 1, min(self.k, self.dim))).drop("raw", "scaled", "pca")


def fit_head(df: DataFrame, vector_col: str, label: str, reg: float = 1e-4, epochs: int = 100) -> LogisticRegressionModel:
    """A softmax head on vectors, classes weighing the same; saved and loaded as any model."""
    weights = {r[0]: r[2] for r in class_weights(df, label).collect()}
    by = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col(label)]
    rows = df.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), by.alias("weight"))
    return LogisticRegression(maxIter=epochs, regParam=reg, weightCol="weight", family="multinomial").fit(rows)


def fit_mlp(df: DataFrame, vector_col: str, label: str, hidden: int = 256, epochs: int = 100, seed: int = 42) -> MultilayerPerceptronClassificationModel:
    """A network with one hidden layer on vectors; labels are codes from 0."""
    rows = df.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    classes = int(rows.agg(F.max("label")).first()[0]) + 1
    return MultilayerPerceptronClassifier(layers=[rows.first()["features"].size, hidden, classes], maxIter=epochs, seed=seed).fit(rows)


def cross_validated(df: DataFrame, folds: DataFrame, key: str, vector_col: str, label: str, fit=None) -> DataFrame:
    """(fold, y_true, y_pred) on the validation rows of each fold (key, fold, role), the head
    being fitted on its training rows. Folds are few; each is one fit."""
    parts = []
    for fold in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        of = lambda role, f=fold: df.join(folds.where((F.col("fold") == f) & (F.col("role") == role)).select(key), key, "left_semi")
        model = (fit or fit_head)(of("train"), vector_col, label)
        parts.append(score_head(of("val"), model, vector_col).select(F.lit(fold).alias("fold"), F.col(label).alias("y_true"), "y_pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_windows(pooled_: DataFrame) -> DataFrame:
    """(n_docs, mean_windows)."""
    return pooled_.agg(F.count("*").alias("n_docs"), F.avg("window_count").alias("mean_windows"))


def score_head(df: DataFrame, model: LogisticRegressionModel | MultilayerPerceptronClassificationModel, vector_col: str) -> DataFrame:
    """``df`` with ``proba`` (array) and ``y_pred``."""
    made = df.withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))
    made = model.transform(made)
    return made.withColumns({"proba": vector_to_array("probability"), "y_pred": F.col("prediction").cast("int")}).drop("features", "rawPrediction", "probability", "prediction")


def smoothed_losses(losses: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average of an array of losses."""
    return F.aggregate(losses, F.expr("cast(array() as array<double>)"), lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(alpha * x + (1 - alpha) * F.element_at(a, -1)))))


def stop_epoch(losses: Column, patience: int = 10) -> Column:
    """Epoch (from 1) at which ``patience`` epochs have passed without a new least loss, or
    the last one."""
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("wait"), F.lit(0).alias("at"), F.lit(False).alias("done"))

    def step(a, x):
        better = x < a["best"]
        wait = F.when(better, 0).otherwise(a["wait"] + 1)
        moved = F.struct(F.least(a["best"], x).alias("best"), wait.alias("wait"), (a["at"] + 1).alias("at"), (wait >= patience).alias("done"))
        return F.when(a["done"], a).otherwise(moved)

    return F.aggregate(losses, zero, step, lambda a: a["at"])


__all__ = ["ScaledPCA", "class_weights", "cross_validated", "fit_head", "fit_mlp", "mean_windows", "pooled", "positive_weight", "score_head", "smoothed_losses", "spaced_subset", "stop_epoch", "token_windows"]
