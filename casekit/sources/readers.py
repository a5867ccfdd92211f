"""Sources: raw JSON records, tables by format, model artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.rules import normalise_case_type
from ..operators.curate import require_columns
from ..vocabulary import FILE_KEYWORDS
from .json_arrays import read_json_arrays
from .schema import RAW


def flatten(df: DataFrame, schema: StructType = RAW) -> DataFrame:
    """Nested structs to columns named ``outer_inner``."""
    out: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StructType):
            out += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def read_raw(spark: SparkSession, raw_dir: str, case_type: str) -> DataFrame:
    """All raw records of a case type: JSON arrays in files whose name has its keyword.

    Flat columns, and ``source_file`` and ``_row_id``, a struct of the file's name and the
    record's place in it, which orders rows by file name, then as they stand. A folder
    without such files raises. Files are cut into blocks that many tasks read.
    """
    word = FILE_KEYWORDS[normalise_case_type(case_type)]
    pattern = spark._jvm.org.apache.hadoop.fs.Path(raw_dir, f"*{word}*.json")
    if not pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        raise ValueError(f"no files with {word} in {raw_dir}")
    rows = read_json_arrays(spark, pattern.toString(), RAW)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rows = rows.select(F.struct(name.alias("file"), "place").alias("_row"), name.alias("source_file"), "record.*")
    return flatten(rows).withColumn("_row_id", F.struct("_row_file", "_row_place")).drop("_row_file", "_row_place")


def file_counts(df: DataFrame) -> DataFrame:
    """(source_file, n)."""
    return df.groupBy("source_file").agg(F.count("*").alias("n"))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or JSON by the path's suffix, only ``columns`` if given; other suffixes
    raise. CSV has a header, quoted line ends and doubled quotes."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".parquet"):
        out = reader.parquet(path)
    elif path.endswith(".csv"):
        out = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif path.endswith((".json", ".jsonl")):
        out = reader.json(path)
    else:
        raise ValueError(f"unknown format: {path}")
    if columns is None:
        return out
    require_columns(out, columns)
    return out.select(*columns)


def read_cases(spark: SparkSession, path: str, columns: Sequence[str], id_col: str) -> DataFrame:
    """A CSV as trimmed text, nulls empty, rows without an id dropped."""
    out = read_table(spark, path, columns).select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    return out.where(F.col(id_col) != "")


def first_path(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists; an error lists all that were tried."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    raise FileNotFoundError(f"none of {list(candidates)}")


def case_type_of(name: Column) -> Column:
    """dv or boc by a file's name: its keyword, a ``dv`` or ``boc`` prefix, or ``_ic_``."""
    low = F.lower(F.regexp_extract(name, "([^/]+)$", 1))
    dv = F.startswith(low, F.lit("dv")) | F.contains(low, F.lit(FILE_KEYWORDS["dv"]))
    boc = F.startswith(low, F.lit("boc")) | F.contains(low, F.lit("_ic_")) | F.contains(low, F.lit(FILE_KEYWORDS["boc"]))
    return F.when(dv, "dv").when(boc, "boc")
