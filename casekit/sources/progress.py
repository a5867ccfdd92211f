"""Long work in portions that survive a failure: parts, and a manifest of the parts that count.

A part is written first and counts once its entry in the manifest is there, so that whatever
a killed run leaves behind is neither read nor missed. Entries hold a Bloom filter of the
part's keys by bucket: a rerun rules most keys out by filters and reads the keys of the few
parts and buckets that may hold the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F

from .shared import discarded, written

#: Keys of a bucket, about; bits and probes of a key in a filter.
BUCKET_KEYS, BITS, PROBES = 50_000, 12, 7
#: Portions of a run at most, whatever its size.
MOST_PORTIONS = 16
_MANIFEST = "part string, bucket int, n long, size long, bits binary"
_FILTERS = "bucket int, n long, size long, bits binary"


def _probes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of keys in a filter of ``size`` bits, one row each, from two halves of a hash."""
    h = hashes.astype(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((one[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * two[:, None]) % np.uint64(size)).astype(np.int64)


def bloom(hashes: np.ndarray) -> tuple[int, bytes]:
    """(size in bits, filter) of 64-bit hashes; it holds all of them, and of others about
    three in a thousand."""
    size = max(64, 8 * -(-len(hashes) * BITS // 8))
    bits = np.zeros(size, np.uint8)
    bits[_probes(hashes, size).ravel()] = 1
    return size, np.packbits(bits).tobytes()


def may_hold(hashes: np.ndarray, size: int, bits: bytes) -> np.ndarray:
    """Whether the filter may hold each hash; false only where it does not."""
    return np.unpackbits(np.frombuffer(bits, np.uint8))[:size][_probes(hashes, size)].all(axis=1)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    size, bits = bloom(rows["h"].to_numpy(np.int64))
    return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].to_numpy(), "n": [len(rows)], "size": [size], "bits": [bits]})


def _asked(keys: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """(part, bucket, h) of the keys of one bucket that a part may hold."""
    h, out = keys["h"].to_numpy(np.int64), []
    for part, size, bits in zip(entries["part"], entries["size"], entries["bits"]) if len(h) else ():
        hit = h[may_hold(h, int(size), bits)]
        out.append(pd.DataFrame({"part": part, "bucket": keys["bucket"].iloc[0], "h": hit}))
    return pd.concat(out) if out else pd.DataFrame({"part": pd.Series(dtype=str), "bucket": pd.Series(dtype="int32"), "h": pd.Series(dtype="int64")})


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class ProgressLog:
    """The parts under ``path`` of work that is done by ``key``, in ``buckets`` of keys.

    The number of buckets is fixed by the first run: keys over ``BUCKET_KEYS``.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.read_folders = 0  # by the last call of ``left``

    def manifest(self) -> DataFrame:
        """(part, bucket, n, size, bits) of the parts that count."""
        if not _exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")

    def parts(self) -> list[str]:
        return sorted(r[0] for r in self.manifest().select("part").distinct().collect())

    def read(self) -> DataFrame | None:
        """The results of all parts that count; None before the first."""
        found = self.parts()
        return self._files().parquet(*[f"{self.path}/parts/{p}" for p in found]) if found else None

    def _files(self) -> DataFrameReader:
        """Reads files wherever they are below the given folders, whatever these are called."""
        return self.spark.read.option("recursiveFileLookup", "true")

    def _buckets(self, n: int) -> int:
        """The number of buckets, as the first run wrote it."""
        if not _exists(self.spark, f"{self.path}/buckets/_SUCCESS"):
            self.spark.createDataFrame([(max(1, -(-n // BUCKET_KEYS)),)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/buckets")
        return self.spark.read.parquet(f"{self.path}/buckets").first()[0]

    def _keyed(self, df: DataFrame, buckets: int) -> DataFrame:
        h = F.xxhash64(F.col(self.key).cast("string"))
        return df.withColumns({"_h": h, "_bucket": F.pmod(h, F.lit(buckets)).cast("int")})

    def left(self, todo: DataFrame, buckets: int) -> DataFrame:
        """The rows of ``todo`` whose key no part has. Filters name the parts and buckets that
        may have some; keys are read from those alone."""
        entries = self.manifest()
        keys = self._keyed(todo.select(self.key).distinct(), buckets).select(F.col("_bucket").alias("bucket"), F.col("_h").alias("h"))
        maybe = keys.groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInPandas(_asked, "part string, bucket int, h long")
        maybe = written(maybe, "maybe_done")
        hit = maybe.groupBy("part").agg(F.collect_set("bucket").alias("buckets")).collect()
        self.read_folders = 0
        if not hit:
            return todo
        folders = [f"{self.path}/parts/{r['part']}/_bucket={b}" for r in hit for b in r["buckets"]]
        self.read_folders = len(folders)
        done = self._files().parquet(*folders).select(self.key).distinct()
        return todo.join(done, self.key, "left_anti")

    def run(self, todo: DataFrame, work: Callable[[DataFrame], DataFrame], every: int | None = None) -> int:
        """Do ``work`` on the rows of ``todo`` whose key is not done; returns the number of
        parts that were added.

        ``work`` keeps the key. With ``every``, the rows are taken in portions of about as
        many, at most ``MOST_PORTIONS`` whatever their number, each of which counts when a
        later one fails. A key that ``work`` drops is done again by the next run. Rows with a
        null key are never done, so they are left out.
        """
        todo = todo.where(F.col(self.key).isNotNull())
        buckets = self._buckets(todo.count())
        left = written(self._keyed(self.left(todo, buckets), buckets), "left")
        n = left.count()
        portions = 0 if n == 0 else 1 if every is None else max(1, min(MOST_PORTIONS, -(-n // every)))
        for i in range(portions):
            # Other bits of the hash than the buckets', so that a portion has some of each.
            mine = left.where(F.pmod(F.shiftright("_h", 20), F.lit(portions)) == i).select(*todo.columns)
            self._add(work(mine), buckets)
        discarded(self.spark, left)
        return portions

    def _add(self, results: DataFrame, buckets: int) -> None:
        """Write a part, then its entry, which makes it count."""
        part = uuid.uuid4().hex
        folder = f"{self.path}/parts/{part}"
        self._keyed(results, buckets).drop("_h").write.partitionBy("_bucket").parquet(folder)
        kept = self._files().schema(results.schema).parquet(folder)
        hashes = self._keyed(kept.select(self.key).distinct(), buckets).select(F.col("_bucket").alias("bucket"), F.col("_h").alias("h"))
        entry = hashes.groupBy("bucket").applyInPandas(_summed, _FILTERS)
        entry.select(F.lit(part).alias("part"), "bucket", "n", "size", "bits").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def clean(self) -> int:
        """Delete the parts that don't count; only while nothing runs. Returns their number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return 0
        counts, gone = set(self.parts()), 0
        for entry in fs.listStatus(folder):
            if entry.getPath().getName() not in counts:
                fs.delete(entry.getPath(), True)
                gone += 1
        return gone
