"""Tables that are written once in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, where that is unset and the master is local, a temporary
    folder of this process. Raises on a cluster, whose machines share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="casekit-"))
    return _OWN[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read back, so that it is computed
    once and a lost executor costs nothing that was written."""
    path = f"{shared_folder(df.sparkSession)}/casekit/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._casekit_path = path
    return out


def discarded(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete what ``written`` wrote for ``tables``; only once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_casekit_path", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
