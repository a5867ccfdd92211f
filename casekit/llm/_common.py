"""Helpers shared by the training-data operators: tables in the shared folder, table reads."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

_FALLBACK: list[str] = []
_CACHE: dict[object, object] = {}
_LEAN: list[bool] = []


def worker_cache(owner: object, make):
    """What ``make()`` gave for ``owner`` in this worker. A worker keeps the cache of one
    owner at a time, so that operators that follow one another don't add up."""
    if owner not in _CACHE:
        drop_worker_caches()
        _CACHE[owner] = make()
    return _CACHE[owner]


def drop_worker_caches() -> None:
    """Free what operators before have kept in this worker. Every function that runs in
    workers and keeps nothing itself begins with it: workers are used again by later stages.

    From the first call on, large blocks go back to the system as soon as they are free, in
    Arrow and in the C library, as several workers share an executor's memory.
    """
    if not _LEAN:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL(None)
            for option, value in ((-8, 1), (-3, 256 << 10), (-1, 1 << 20)):  # arenas, mmap threshold, trim threshold
                libc.mallopt(option, value)
        except (AttributeError, OSError):
            pass  # another C library
        _LEAN.append(True)
    _CACHE.clear()


def trim_memory() -> None:
    """Give the memory that this process has freed back to the system, where that can be."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``column`` have about ``most`` bytes, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand workers at most ``rows`` rows at a time in this session, as a row is a whole
    document; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that
    is unset and the master is local (tests), a temporary folder of this process. Raises on a
    cluster, whose machines share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="casekit-"))
    return _FALLBACK[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/casekit/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that it ran, not what was written.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._casekit_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; only once nothing reads it any more."""
    path = getattr(df, "_casekit_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have the driver drop what nothing refers to any more: shuffle files and broadcasts of
    finished steps go with their last reference, which else waits for a collection of the
    driver's garbage, half an hour by default. For a few calls between an operator's steps."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a bitmap's row, as a power of two.
_CHUNK = 16


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap (``likely``) for ``n`` keys, as a power of two: keys set a 64th of them
    at most, so that what passes by chance stays a fixed share, up to 2 ** 27 bits (16 MB)."""
    return min(27, max(25, (64 * n - 1).bit_length()))


def likely(rows: DataFrame, key: str, need: DataFrame, bits: int = 24, there: bool = True) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``need``, before they move; or,
    if not ``there``, exactly the rows that this leaves out.

    A bitmap of 2 ** ``bits`` bits (2 MB by default), whatever the size of ``need``, is made
    by Spark, written to the shared folder and goes to all tasks; the driver's Python holds
    nothing of it. Follow it by an inner join: the optimiser would move a semi join before it.
    """
    place = f"pmod(xxhash64({key}), {1 << bits})"
    words = need.select(F.expr(f"{place} div 64").alias("w"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))").alias("b"))
    zeros = rows.sparkSession.range(1 << bits - 6).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = words.unionByName(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
    chunks = words.groupBy(F.expr(f"w div {1 << _CHUNK - 6}").alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("x"))
    bitmap = materialize(chunks.select("_chunk", F.col("x.b").alias("_bits")), "bitmap")
    release(rows.sparkSession)
    marked = rows.withColumn("_place", F.expr(place)).withColumn("_chunk", F.expr(f"_place div {1 << _CHUNK}"))
    hit = F.expr(f"_bits[cast(_place % {1 << _CHUNK} div 64 as int)] & shiftleft(1L, cast(_place % 64 as int)) <> 0")
    found = marked.join(F.broadcast(bitmap), "_chunk").where(hit if there else ~hit)
    return found.select(*rows.columns)
