"""Raw records as a stream: new files are curated and added once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import normalise_case_type
from ..sources.readers import flatten
from ..sources.schema import RAW
from ..vocabulary import FILE_KEYWORDS
from .frontier import rocks


def raw_stream(spark: SparkSession, raw_dir: str, case_type: str, files_at_once: int = 100) -> DataFrame:
    """New raw files of a case type as they appear, one row per record, with ``source_file``."""
    word = FILE_KEYWORDS[normalise_case_type(case_type)]
    lines = spark.readStream.schema(RAW).option("multiLine", True).option("pathGlobFilter", f"*{word}*.json").option("maxFilesPerTrigger", files_at_once).json(raw_dir)
    return flatten(lines.withColumn("source_file", F.col("_metadata.file_name")).withColumn("arrived", F.col("_metadata.file_modification_time")))


def first_arrivals(stream: DataFrame, key: str = "n_processo", within: str = "30 days") -> DataFrame:
    """The first row of each key within a span of arrival times; state beyond it is dropped."""
    return stream.withWatermark("arrived", within).dropDuplicatesWithinWatermark([key])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that lasts as long as the checkpoint."""
    place = f"{checkpoint}/run_name"
    if not _exists(spark, f"{place}/_SUCCESS"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place).first()[0]


def add_new(stream: DataFrame, path: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Add the rows of ``stream``, after ``work``, to the table at ``path``, the first of each
    key (null is one, too) over all runs with this ``checkpoint``.

    Keys that came before are in the stream's state, so a batch costs what its own rows do,
    however large the table is. Batches are folders ``run=<name>/batch=<number>`` that are
    written anew when a batch is run again after a failure, so each row is there once. Keys
    that other runs put into the table are left out as well; only such rows are read.
    """
    spark = stream.sparkSession
    run = _run_of(spark, checkpoint)
    others = None
    if _exists(spark, path):
        found = spark.read.parquet(path)
        if "run" not in found.columns:
            raise ValueError(f"{path} has a table of another make")
        others = found.where(F.col("run") != run).select(key)
        others = None if others.isEmpty() else others.distinct()

    def put(batch: DataFrame, number: int) -> None:
        rows = batch if others is None else batch.join(others, key, "left_anti")
        rows = rows if work is None else work(rows)
        rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    with rocks(spark):
        writer = stream.dropDuplicates([key]).writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/stream")
        return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(stream: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and key; rows later than ``late`` are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n"))
