"""A classification head trained on tables of vectors: gradients are summed where the rows
are, AdamW steps on the sums, and a smoothed validation loss ends the fit.

Each epoch is one pass: rows meet the weights of the epoch, tasks add up the gradient of the
training rows and the loss of the validation rows, and the sums are merged on the executors
before a few of them reach the driver. What the driver holds is some copies of the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..sources.shared import shared_folder
from .pooling import class_weights

#: Sums that reach the driver in an epoch.
FAN = 16
#: Classes that a head may have.
MOST_CLASSES = 1000
_CHUNK = 4096
_SUMS = "part int, gradient array<double>, train_loss double, train_weight double, val_loss double, val_weight double"


@dataclass(frozen=True)
class Settings:
    """How a head is fitted. ``hidden`` widths of ReLU layers (none: softmax regression from
    zero weights); ``smooth`` the weight of the new validation loss in its moving average (1:
    the loss itself); ``patience`` epochs without a new least value end the fit; ``warmup``
    the share of epochs over which the rate rises, after which it falls to 0 if ``decay``;
    ``clip`` bounds the gradient's norm; ``l1`` weighs the sum of sizes of all weights."""

    hidden: tuple[int, ...] = (256,)
    epochs: int = 100
    rate: float = 1e-3
    weight_decay: float = 1e-2
    l1: float = 0.0
    patience: int = 10
    smooth: float = 0.3
    label_smoothing: float = 0.0
    clip: float | None = None
    warmup: float = 0.0
    decay: bool = False
    balanced: bool = True
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    seed: int = 42

    def rate_at(self, epoch: int) -> float:
        """The rate of the step after pass ``epoch`` (from 0)."""
        rising = int(self.epochs * self.warmup)
        if epoch < rising:
            return self.rate * (epoch + 1) / rising
        return self.rate * (self.epochs - epoch) / max(1, self.epochs - rising) if self.decay else self.rate


@dataclass(frozen=True)
class Head:
    """A fitted head: ``layers`` widths from the vectors' dimension to the classes, all
    weights in one array, the classes' labels, and the curves of the fit."""

    layers: tuple[int, ...]
    theta: np.ndarray
    classes: tuple
    train_losses: tuple[float, ...] = ()
    val_losses: tuple[float, ...] = ()
    best_epoch: int = 0


@dataclass(frozen=True)
class _State:
    """What a run needs to go on: weights, moments, the best weights and the stop's counters."""

    epoch: int
    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    best_signal: float = float("inf")
    best_epoch: int = 0
    signal: float | None = None
    wait: int = 0
    train_losses: tuple[float, ...] = field(default=())
    val_losses: tuple[float, ...] = field(default=())
    done: bool = False


def weights_of(theta: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, bias) of each layer, as views of ``theta``."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def initial(layers: Sequence[int], seed: int) -> np.ndarray:
    """He's normal weights and zero biases; all zeros without a hidden layer."""
    rng, parts = np.random.default_rng(seed), []
    for a, b in zip(layers, layers[1:]):
        parts += [rng.normal(scale=np.sqrt(2 / a), size=a * b) if len(layers) > 2 else np.zeros(a * b), np.zeros(b)]
    return np.concatenate(parts)


def _forward(theta: np.ndarray, layers: Sequence[int], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    inputs = [x]
    parts = weights_of(theta, layers)
    for w, b in parts[:-1]:
        inputs.append(np.maximum(inputs[-1] @ w + b, 0.0))
    z = inputs[-1] @ parts[-1][0] + parts[-1][1]
    z = z - z.max(axis=1, keepdims=True)
    return inputs, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def probabilities(head: Head, x: np.ndarray) -> np.ndarray:
    return np.exp(_forward(head.theta, head.layers, np.asarray(x, float))[1])


def loss_sum(theta: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray, label_smoothing: float = 0.0, gradient: bool = True) -> tuple[float, np.ndarray | None]:
    """Weighted sum of the rows' cross entropies against smoothed targets, and its gradient."""
    inputs, logs = _forward(theta, layers, x)
    k = layers[-1]
    target = np.full_like(logs, label_smoothing / k)
    target[np.arange(len(y)), y] += 1 - label_smoothing
    loss = float(-(weight[:, None] * target * logs).sum())
    if not gradient:
        return loss, None
    out = np.zeros_like(theta)
    back = weight[:, None] * (np.exp(logs) - target)
    for (w, _), (gw, gb), a in zip(reversed(weights_of(theta, layers)), reversed(weights_of(out, layers)), reversed(inputs)):
        gw[:], gb[:] = a.T @ back, back.sum(axis=0)
        back = (back @ w.T) * (a > 0)
    return loss, out


def step(state: _State, gradient: np.ndarray, settings: Settings) -> _State:
    """One AdamW step: the decay is taken off the weights, not added to the gradient."""
    g = gradient + settings.l1 * np.sign(state.theta)
    if settings.clip is not None and (size := float(np.linalg.norm(g))) > settings.clip:
        g = g * (settings.clip / size)
    b1, b2 = settings.betas
    t, rate = state.epoch + 1, settings.rate_at(state.epoch)
    first, second = b1 * state.first + (1 - b1) * g, b2 * state.second + (1 - b2) * g * g
    move = (first / (1 - b1**t)) / (np.sqrt(second / (1 - b2**t)) + settings.eps)
    return replace(state, epoch=t, theta=state.theta * (1 - rate * settings.weight_decay) - rate * move, first=first, second=second)


def judged(state: _State, val_loss: float, settings: Settings) -> _State:
    """``state`` after its validation loss: the moving average, the best weights, whether to stop."""
    signal = val_loss if state.signal is None else settings.smooth * val_loss + (1 - settings.smooth) * state.signal
    state = replace(state, signal=signal, val_losses=(*state.val_losses, val_loss))
    if signal < state.best_signal:
        return replace(state, best_signal=signal, best=state.theta, best_epoch=state.epoch, wait=0)
    return replace(state, wait=state.wait + 1, done=state.wait + 1 >= settings.patience)


def _passed(theta: np.ndarray, layers: tuple[int, ...], weights: np.ndarray, label_smoothing: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, sums = np.zeros_like(theta), np.zeros(4)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, layers[0])
            y, held = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for at in range(0, len(y), _CHUNK):
                for val in (False, True):
                    some = np.flatnonzero(held[at : at + _CHUNK] == val) + at
                    if len(some):
                        loss, g = loss_sum(theta, layers, x[some], y[some], weights[y[some]], label_smoothing, not val)
                        sums[2 * val : 2 * val + 2] += loss, weights[y[some]].sum()
                        if g is not None:
                            total += g
        if sums.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "gradient": [total], **{n: [s] for n, s in zip(("train_loss", "train_weight", "val_loss", "val_weight"), sums)}})

    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of tasks, added in the order of the tasks, so that reruns agree to the last bit."""
    rows = rows.sort_values("part")
    return pd.DataFrame({"part": rows["part"].iloc[:1].to_numpy(), "gradient": [np.sum(np.stack(rows["gradient"].to_list()), axis=0)], **{n: [rows[n].sum()] for n in ("train_loss", "train_weight", "val_loss", "val_weight")}})


def epoch_sums(rows: DataFrame, theta: np.ndarray, layers: tuple[int, ...], weights: np.ndarray, label_smoothing: float = 0.0) -> tuple[np.ndarray, float, float | None]:
    """(mean gradient, mean loss) of the training rows, and the mean loss of the validation
    rows (None without any), of ``rows`` (x, y, held), each weighted by its class."""
    parts = rows.mapInArrow(_passed(theta, layers, weights, label_smoothing), _SUMS)
    total = _merged(parts.groupBy(F.col("part") % FAN).applyInPandas(_merged, _SUMS).toPandas()).iloc[0]
    val = float(total["val_loss"] / total["val_weight"]) if total["val_weight"] else None
    return np.asarray(total["gradient"]) / total["train_weight"], float(total["train_loss"] / total["train_weight"]), val


_ARRAYS, _SCALARS = ("theta", "first", "second", "best", "train_losses", "val_losses"), ("epoch", "best_signal", "best_epoch", "signal", "wait", "done")
_STATE = "epoch int, theta array<double>, first array<double>, second array<double>, best array<double>, train_losses array<double>, val_losses array<double>, best_signal double, best_epoch int, signal double, wait int, done boolean"


def _save(spark: SparkSession, state: _State, path: str) -> None:
    row = [state.epoch, *[[float(v) for v in getattr(state, n)] for n in _ARRAYS], state.best_signal, state.best_epoch, state.signal, state.wait, state.done]
    spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/states/{state.epoch:06d}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _last(spark: SparkSession, path: str) -> _State | None:
    """The last state that was written whole."""
    if not _exists(spark, f"{path}/states"):
        return None
    row = spark.read.schema(_STATE).parquet(f"{path}/states/*").orderBy(F.desc("epoch")).first()
    if row is None:
        return None
    arrays = {n: np.array(row[n]) if i < 4 else tuple(row[n]) for i, n in enumerate(_ARRAYS)}
    return _State(**arrays, **{n: row[n] for n in _SCALARS})


def fit_network(df: DataFrame, vector_col: str, label: str, held_out: str, settings: Settings = Settings(), path: str | None = None) -> Head:
    """A head on ``vector_col`` that predicts ``label``, trained on the rows where the boolean
    ``held_out`` is false and stopped by those where it is true.

    Rows whose vector, label or ``held_out`` is null are left out, as are validation rows of
    a label that no training row has; vectors must have one length. Classes weigh n / (k
    count) if balanced. Without validation rows all epochs run and the last weights count;
    else the weights with the least smoothed loss. No training row is an error.

    With ``path``, rows and the state after every epoch are written there, and a run that
    was broken off goes on from the last state, with the same results as an unbroken one.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/casekit/head-{np.random.default_rng().integers(1 << 62):x}"
    rows = df.where(F.col(vector_col).isNotNull() & F.col(label).isNotNull() & F.col(held_out).isNotNull())
    counts = class_weights(rows.where(~F.col(held_out)), label).orderBy(label).limit(MOST_CLASSES + 1).collect()
    if not 0 < len(counts) <= MOST_CLASSES:
        raise ValueError(f"{len(counts)} classes among the training rows")
    classes = tuple(r[0] for r in counts)
    weights = np.array([r["weight"] if settings.balanced else 1.0 for r in counts])
    if not _exists(spark, f"{path}/rows/_SUCCESS"):
        code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
        rows.select(F.col(vector_col).cast("array<double>").alias("x"), code.cast("int").alias("y"), F.col(held_out).alias("held")).where("y >= 0").write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema("x array<double>, y int, held boolean").parquet(f"{path}/rows")
    low, high = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} entries")
    layers = (high, *settings.hidden, len(classes))
    state = _last(spark, path)
    if state is None:
        theta = initial(layers, settings.seed)
        state = _State(0, theta, np.zeros_like(theta), np.zeros_like(theta), theta)
    while not state.done:
        gradient, train_loss, val_loss = epoch_sums(rows, state.theta, layers, weights, settings.label_smoothing)
        # A pass gives the loss of the weights that the step before it made.
        if state.epoch and val_loss is not None:
            state = judged(state, val_loss, settings)
        elif val_loss is None:
            state = replace(state, best=state.theta, best_epoch=state.epoch)
        if state.epoch == settings.epochs:
            state = replace(state, done=True)
        if not state.done:
            state = replace(step(state, gradient, settings), train_losses=(*state.train_losses, train_loss))
        _save(spark, state, path)
    return Head(layers, state.best, classes, state.train_losses, state.val_losses, state.best_epoch)


def score_network(df: DataFrame, head: Head, vector_col: str) -> DataFrame:
    """``df`` with ``proba`` (array<double> by class) and ``y_pred``, the label of the first
    greatest one; both null for a null vector."""
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(len(kept))
            there = vectors.is_valid().to_numpy(zero_copy_only=False)
            x = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, head.layers[0])
            found = iter(probabilities(head, x) if len(x) else ())
            rows = [next(found) if ok else None for ok in there]
            best = [None if p is None else int(np.argmax(p)) for p in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64())), pa.array(best, pa.int32())], [*kept, "proba", "_code"])

    schema = StructType([*df.schema.fields, StructField("proba", ArrayType(DoubleType())), StructField("_code", IntegerType())])
    scored = df.withColumn("_x", F.col(vector_col).cast("array<double>")).mapInArrow(run, schema)
    named = F.array(*[F.lit(c) for c in head.classes])
    return scored.withColumn("y_pred", F.get(named, F.col("_code"))).drop("_code")


def save_head(spark: SparkSession, head: Head, path: str) -> None:
    """Write ``head`` under ``path``, replacing what is there."""
    row = [list(head.layers), [float(v) for v in head.theta], list(head.classes), list(head.train_losses), list(head.val_losses), head.best_epoch]
    kind = "string" if isinstance(head.classes[0], str) else "double" if isinstance(head.classes[0], float) else "long"
    spark.createDataFrame([row], f"layers array<int>, theta array<double>, classes array<{kind}>, train_losses array<double>, val_losses array<double>, best_epoch int").write.mode("overwrite").parquet(path)


def load_head(spark: SparkSession, path: str) -> Head:
    r = spark.read.parquet(path).first()
    return Head(tuple(r["layers"]), np.array(r["theta"]), tuple(r["classes"]), tuple(r["train_losses"]), tuple(r["val_losses"]), r["best_epoch"])
