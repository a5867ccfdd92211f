"""Pluggable predictors over texts and their prediction tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.rules import label_code, normalise_case_type
from ..functions.text import clean_basic, words
from ..vocabulary import LABELS
from .batches import in_batches
from .pooling import pooled, spaced_subset, token_windows
from .sentences import encoded, hash_encoder

Predictor = Callable[[list[str]], np.ndarray]


def scored(text: Column, predictor: Callable[[], Predictor], batch: int = 32) -> Column:
    """array<double> of class scores of each text. ``predictor`` makes the function, once
    a worker task; it takes up to ``batch`` texts, fewer where memory does not do, and gives
    one row each."""

    @pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = predictor()
        for part in parts:
            texts = ["" if t is None else t for t in part]
            rows = [list(map(float, r)) for r in in_batches(predict, texts, batch)]
            yield pd.Series(rows, index=part.index, dtype="object")

    return run(text)


def score_texts(df: DataFrame, columns: dict[str, str], predictor: Callable[[], Predictor], batch: int = 32) -> DataFrame:
    """``df`` with each text column of ``columns`` (text, scores) replaced by the array<double>
    of its class scores; the other columns pass through in Arrow batches as they are."""
    kept = [c for c in df.columns if c not in columns]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor()
        for part in parts:
            out = [part.column(part.schema.get_field_index(c)) for c in kept]
            for name in columns:
                texts = [t or "" for t in part.column(part.schema.get_field_index(name)).to_pylist()]
                rows = [list(map(float, r)) for r in in_batches(predict, texts, batch)]
                out.append(pa.array(rows, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, [*kept, *columns.values()])

    schema = StructType([df.schema[c] for c in kept] + [StructField(c, ArrayType(DoubleType())) for c in columns.values()])
    return df.mapInArrow(run, schema)


def prediction_table(df: DataFrame, predictor: Callable[[], Predictor], id_col: str, text_col: str, label_col: str, case_type: str, run_name: str, split: str | None = None) -> DataFrame:
    """(n_processo, y_true, y_pred, proba_<CLASS>…, run_name, case_type[, split]). Labels
    that are not of the case type raise; the first greatest score is predicted."""
    case_type = normalise_case_type(case_type)
    rows = df.select(F.col(id_col).cast("string").alias("n_processo"), label_code(F.col(label_col), case_type, strict=True).alias("y_true"), scored(F.col(text_col), predictor).alias("_p"))
    proba = [F.get("_p", F.lit(code)).alias(f"proba_{name}") for name, code in LABELS[case_type].items()]
    out = rows.select("n_processo", "y_true", (F.array_position("_p", F.array_max("_p")) - 1).cast("int").alias("y_pred"), *proba, F.lit(run_name).alias("run_name"), F.lit(case_type).alias("case_type"))
    return out if split is None else out.withColumn("split", F.lit(split))


def document_vectors(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[], Callable] = hash_encoder, size: int = 512, overlap: int = 128, most: int | None = None, weighted: bool = True) -> DataFrame:
    """(id, window_count, embedding): windows of whitespace tokens encoded and averaged, by
    their tokens if ``weighted``; ``most`` takes equally spaced windows."""
    wins = token_windows(words(clean_basic(F.col(text_col))), size, overlap)
    wins = wins if most is None else spaced_subset(wins, most)
    rows = df.select(id_col, F.explode(wins).alias("w")).select(id_col, F.greatest(F.size("w"), F.lit(1)).alias("n"), F.array_join("w", " ").alias("t"))
    return pooled(rows.select(id_col, "n", encoded(F.col("t"), encoder).alias("v")), id_col, "v", "n" if weighted else None)


def retrying(ask: Callable[[str], str], parse: Callable[[str], str | None], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str, int]]:
    """A call that is repeated, after 1, 2, 4 … seconds, until its answer parses: (label or
    null, last answer, attempts)."""

    def run(prompt: str) -> tuple[str | None, str, int]:
        answer = ""
        for attempt in range(1, tries + 1):
            try:
                answer = ask(prompt)
                if (label := parse(answer)) is not None:
                    return label, answer, attempt
            except OSError as e:
                answer = f"error: {e}"
            if attempt < tries:
                pause(2.0 ** (attempt - 1))
        return None, answer, tries

    return run


def generated(df: DataFrame, transport: Callable[[], Callable[[str], tuple[str | None, str, int]]], id_col: str, prompt_col: str, batch: int = 16) -> DataFrame:
    """(id, label, raw, attempts) of a text generator behind an injectable transport, by
    Arrow batches; the transport is made once a worker task. Ids are text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = transport()
        for part in parts:
            rows = [(i, *ask(p or "")) for i, p in zip(part["id"], part["prompt"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "label", "raw", "attempts"])

    made = df.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).alias("prompt")).mapInPandas(run, "id string, label string, raw string, attempts int")
    return made.withColumnRenamed("id", id_col)
