"""A frontier of links as state: each link leaves once, however often and however late it is
found again, and no host is asked faster than its pace.

What was seen is kept in the state store by host, so that a batch looks up its own links and
reads nothing else; the state outlives restarts with the query's checkpoint.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

OUT = StructType([StructField("host", StringType()), StructField("href", StringType()), StructField("place", LongType())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Frontier(StatefulProcessor):
    """State of a host: links seen; links that wait, by place; the first and next place, and
    when the next one may leave."""

    def __init__(self, pace_ms: int):
        self.pace_ms = pace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        text, number = StructType([StructField("href", StringType())]), StructType([StructField("place", LongType())])
        self.handle = handle
        self.seen = handle.getMapState("seen", text, StructType([StructField("there", BooleanType())]))
        self.waiting = handle.getMapState("waiting", number, text)
        self.marks = handle.getValueState("marks", StructType([StructField(n, LongType()) for n in ("first", "next", "due")]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, after, due = self.marks.get() if self.marks.exists() else (0, 0, 0)
        # In the order of the links, as rows of a batch come in any.
        for href in sorted({r["href"] for r in rows}):
            if not self.seen.containsKey((href,)):
                self.seen.updateValue((href,), (True,))
                if self.pace_ms:
                    self.waiting.updateValue((after,), (href,))
                else:
                    yield Row(host=key[0], href=href, place=after)
                after += 1
        if not self.pace_ms:
            self.marks.update((after, after, 0))
            return
        self.marks.update((first, after, due))
        yield from self._leave(key, timerValues.getCurrentProcessingTimeInMs(), first == after or due == 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._leave(key, timerValues.getCurrentProcessingTimeInMs(), False)

    def _leave(self, key, now: int, idle: bool) -> Iterator[Row]:
        first, after, due = self.marks.get()
        if first < after and now >= due:
            (href,) = self.waiting.getValue((first,))
            self.waiting.removeKey((first,))
            yield Row(host=key[0], href=href, place=first)
            first, due = first + 1, now + self.pace_ms
            self.marks.update((first, after, due))
            if first < after:
                self.handle.registerTimer(due)
        elif first < after and idle:
            self.handle.registerTimer(max(due, now + 1))

    def close(self) -> None:
        pass


def host_of(href: Column) -> Column:
    """The host of a link, lower-cased; an empty text where there is none."""
    return F.lower(F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def frontier(links: DataFrame, href: str = "href", pace: float = 0.0) -> DataFrame:
    """(host, href, place) of the links of the stream ``links`` that were not seen before;
    ``place`` counts a host's links from 0.

    With a ``pace`` in seconds a host's links wait in line, and one leaves when that long has
    passed since the last; they leave in batches that come later, also without new input.
    Null links are left out. A host is one key: its links are looked up one by one.
    """
    rows = links.where(F.col(href).isNotNull()).select(F.col(href).alias("href"), host_of(F.col(href)).alias("host"))
    mode = "ProcessingTime" if pace else "None"
    return rows.groupBy("host").transformWithState(statefulProcessor=_Frontier(int(pace * 1000)), outputStructType=OUT, outputMode="Append", timeMode=mode)


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """State that is larger than memory: queries started meanwhile keep it in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_frontier(links: DataFrame, path: str, checkpoint: str, href: str = "href", pace: float = 0.0, once: bool = True) -> StreamingQuery:
    """Append the frontier of ``links`` to the Parquet table at ``path``, each link once over
    all runs with the same ``checkpoint``; ``once``: what is there, then stop."""
    with rocks(links.sparkSession):
        writer = frontier(links, href, pace).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="200 milliseconds")).start()
