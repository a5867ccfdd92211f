"""Sinks: tables in files, nested JSON, reports, traces, and work that resumes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import stamp
from ..functions.text import safe_fragment
from .progress import MOST_PORTIONS
from .shared import shared_folder


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, in folders by ``by``; rows of a folder are dealt to as few files as the
    engine's rebalancing finds, which splits large folders."""
    out = df.hint("rebalance", *by) if by else df
    out.write.mode(mode).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; arrays and structs as JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat.write.mode(mode).options(**exact).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null fields stay."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def _framed(head: str, tail: str):
    """Lines of one JSON document per partition that has rows: ``head``, the rows with commas
    between them, ``tail``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = head
        for batch in batches:
            lines = []
            for line in batch.column(0).to_pylist():
                lines.append(between + line)
                between = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if between == ",":
            yield pa.RecordBatch.from_arrays([pa.array([tail])], names=["value"])

    return run


def _write_documents(df: DataFrame, path: str, name: str, head: str, tail: str) -> list[str]:
    """One JSON document per partition of ``df``, in files of that name, a stamp and, if there
    are several, a number, in ``path``; their paths. Rows are written as they stream by."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    work = jvm.org.apache.hadoop.fs.Path(at, f".writing-{uuid.uuid4().hex}")
    rows = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(_framed(head, tail), "value string").write.option("compression", "none").text(work.toString())
    parts = sorted(f.getPath().toString() for f in fs.listStatus(work) if f.getPath().getName().startswith("part-") and f.getLen())
    when = spark.range(1).select(stamp(F.current_timestamp())).first()[0]
    out = []
    for k, part in enumerate(parts):
        to = jvm.org.apache.hadoop.fs.Path(at, f"{name}_{when}{f'_{k}' if len(parts) > 1 else ''}.json")
        fs.rename(jvm.org.apache.hadoop.fs.Path(part), to)
        out.append(to.toString())
    fs.delete(work, True)
    return out


def write_json_array(df: DataFrame, path: str, name: str) -> list[str]:
    """JSON arrays of records in files ``<name>_<stamp>.json``, one per partition of ``df``
    (``coalesce`` first for fewer); null fields stay. The paths of the files."""
    return _write_documents(df, path, name, "[", "]")


def write_table_json(df: DataFrame, path: str, name: str) -> list[str]:
    """JSON in the "table" orientation: an object with ``schema`` (fields with name and type)
    and ``data`` (records), one per partition of ``df``, in files as of ``write_json_array``."""
    kinds = {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "number", "float": "number", "boolean": "boolean", "date": "datetime", "timestamp": "datetime"}
    fields = [{"name": c, "type": kinds.get(t, "string")} for c, t in df.dtypes]
    return _write_documents(df, path, name, f'{{"schema":{json.dumps({"fields": fields}, ensure_ascii=False)},"data":[', "]}")


def read_table_json(spark: SparkSession, path: str) -> DataFrame:
    """The records of files in the "table" orientation at ``path`` (a file or folder), typed
    by the schema of the first; each file is one record to the reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    first = files.orderBy("path").select(F.get_json_object("text", "$.schema")).first()[0]
    kinds = {"integer": "bigint", "number": "double", "boolean": "boolean", "datetime": "timestamp"}
    fields = ", ".join(f"`{f['name']}` {kinds.get(f['type'], 'string')}" for f in json.loads(first)["fields"])
    rows = files.select(F.explode(F.from_json("text", f"struct<data: array<struct<{fields.replace('` ', '`: ')}>>>")["data"]).alias("r"))
    return rows.select("r.*")


def nested_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as an object; not-a-number becomes null."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.col(key), F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def write_reports(df: DataFrame, path: str, name: str, html: str) -> None:
    """One text file per report under ``path/report=<safe name>``."""
    df.select(safe_fragment(F.col(name).cast("string")).alias("report"), F.col(html).alias("value")).write.mode("overwrite").partitionBy("report").text(path)


def append_trace(df: DataFrame, path: str) -> None:
    """Add rows to a trace table, stamped."""
    df.withColumn("traced_at", F.current_timestamp()).write.mode("append").parquet(path)


def resume(todo: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], every: int | None = None) -> int:
    """Do ``work`` on the rows of ``todo`` whose key is not in the table at ``path``, and add
    the results; with ``every``, in portions of about as many rows, at most ``MOST_PORTIONS``
    whatever their number, each of which is kept when a later one fails. Returns the number
    of portions that were written."""
    spark = todo.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    left = todo
    if at.getFileSystem(conf).exists(at):
        left = todo.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    n = left.count()
    if n == 0:
        return 0
    portions = 1 if every is None else max(1, min(MOST_PORTIONS, -(-n // every)))
    if portions == 1:
        work(left).write.mode("append").parquet(path)
        return 1
    # Dealt out once, so that a portion reads its own folder only.
    folder = f"{shared_folder(spark)}/casekit/portions-{uuid.uuid4().hex}"
    left.withColumn("_portion", F.pmod(F.xxhash64(key), F.lit(portions)).cast("int")).write.partitionBy("_portion").parquet(folder)
    dealt = spark.read.parquet(folder)
    found = sorted(r[0] for r in dealt.select("_portion").distinct().collect())
    for i in found:
        work(dealt.where(F.col("_portion") == i).select(*todo.columns)).write.mode("append").parquet(path)
    return len(found)


def results_lines(df: DataFrame, metrics: Sequence[str] = ("macro_f1", "mcc")) -> DataFrame:
    """(line): a row's metrics with their intervals as text."""
    parts = [F.format_string(f"{m} %.3f [%.3f, %.3f]", f"{m}_point", f"{m}_ci_lower", f"{m}_ci_upper") for m in metrics]
    return df.select(F.concat_ws("  ", F.concat_ws("/", "model_name", "case_type", "run_name"), *parts).alias("line"))
