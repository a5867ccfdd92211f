"""Files that hold one JSON array of records each, read by many tasks.

Spark's text reader cuts files into blocks at any byte and gives what lies between closing
braces, so that no file is one row. Whether a block begins inside a string, how deep it is,
and how many records came before follow from the blocks before it: each block is summed up
for both answers to the first question, and a file's blocks are then put one after the other.
With that, tasks cut their blocks into records; only records that lie across blocks move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .shared import written

#: Blocks whose states go to all tasks at once (some 100 bytes each); files beyond are read in groups.
BLOCKS_AT_ONCE = 200_000
_STRING_REST = re.compile(r'(?:[^"\\]++|\\.)*+("?)', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+("?)|[{}\[\],]', re.S)
_STATE = "path string, block long, in_string boolean, depth long, place long, root string, begun boolean"


class Marks:
    """Structural characters outside strings, piece by piece; ``in_string`` is whether the
    text so far ends inside a string."""

    def __init__(self, in_string: bool = False):
        self.in_string = in_string

    def of(self, text: str) -> Iterator[tuple[str, int]]:
        """(character, place) of each brace, bracket and comma of ``text``."""
        at = 0
        if self.in_string:
            m = _STRING_REST.match(text)
            if not m[1]:
                return
            self.in_string, at = False, m.end()
        for m in _TOKEN.finditer(text, at):
            if m[1] is None:
                yield m[0], m.start()
            elif not m[1]:
                self.in_string = True


class Summary:
    """What a block does to the state, if it begins inside a string or not: the change of
    depth and the commas by depth, relative to its begin."""

    def __init__(self, in_string: bool):
        self.marks, self.depth, self.commas = Marks(in_string), 0, {}

    def add(self, text: str) -> None:
        for c, _ in self.marks.of(text):
            if c == ",":
                self.commas[self.depth] = self.commas.get(self.depth, 0) + 1
            else:
                self.depth += 1 if c in "{[" else -1


class Cutter:
    """Cuts a block that begins in a known state into records."""

    def __init__(self, in_string: bool, depth: int, place: int, root: str, begun: bool):
        self.marks, self.depth, self.place, self.root = Marks(in_string), depth, place, root
        self.parts, self.whole = [], root == "{" and not begun
        self.closed = root not in ("[", "{") or begun and depth == 0

    def add(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """(place, text, whether it began in this block) of the records that end in ``text``."""
        if self.closed:
            return
        begin, top = 0, 1 if self.root == "[" else 0
        for c, at in self.marks.of(text):
            if c in "{[":
                self.depth += 1
                if top and self.depth == 1:
                    self.parts, self.whole, begin = [], True, at + 1
            elif c != ",":
                self.depth -= 1
                if self.depth == 0:
                    yield self._end(text[begin : at + 1 - top])
                    self.closed = True
                    return
            elif top and self.depth == 1:
                yield self._end(text[begin:at])
                self.place, self.whole, begin = self.place + 1, True, at + 1
        self.parts.append(text[begin:])

    def _end(self, last: str) -> tuple[int, str, bool]:
        out = self.place, "".join([*self.parts, last]), self.whole
        self.parts = []
        return out

    def rest(self) -> Iterator[tuple[int, str, bool]]:
        """What is left open at the block's end."""
        if not self.closed and self.parts:
            yield self.place, "".join(self.parts), False


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, block, value) of blocks, one after the other, to a summary of each."""
    now, both, first = None, (), ""

    def summed() -> pa.RecordBatch:
        commas = pa.list_(pa.list_(pa.int64()))
        columns = {"path": [now[0]], "block": [now[1]], "first": [first]}
        for name, s in zip(("out", "in"), both):
            columns |= {f"{name}_string": [s.marks.in_string], f"{name}_depth": [s.depth], f"{name}_commas": pa.array([[[d, n] for d, n in s.commas.items()]], commas)}
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        for path, block, value in zip(*[c.to_pylist() for c in batch.columns]):
            if (path, block) != now:
                if now is not None:
                    yield summed()
                now, both, first = (path, block), (Summary(False), Summary(True)), ""
            for s in both:
                s.add(value + "}")
            first = first or (value + "}").lstrip("﻿ \t\r\n")[:1]
    if now is not None:
        yield summed()


def _states(blocks: pd.DataFrame) -> pd.DataFrame:
    """The states in which the blocks of one file begin."""
    in_string, depth, place, root, begun, out = False, 0, 0, "", False, []
    for r in blocks.sort_values("block").to_dict("records"):
        here = root or r["first"]
        out.append((r["path"], r["block"], in_string, depth, place, here, begun))
        name = "in" if in_string else "out"
        if here == "[":
            place += sum(int(n) for d, n in r[f"{name}_commas"] if depth + d == 1)
        in_string, depth, root, begun = r[f"{name}_string"], depth + r[f"{name}_depth"], here, bool(here)
    return pd.DataFrame(out, columns=["path", "block", "in_string", "depth", "place", "root", "begun"])


def _cut(wanted: bool):
    """Rows (path, block, value, state) to the records (path, block, place, text) that lie
    within a block (``wanted``), or to the pieces of those that don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter = None, None
        for batch in batches:
            rows = []
            for path, block, value, in_string, depth, place, root, begun in zip(*[c.to_pylist() for c in batch.columns]):
                if (path, block) != now:
                    if root is None:
                        raise ValueError(f"{path} was cut into other blocks than before: fix spark.sql.files.minPartitionNum, or read it anew")
                    if cutter is not None:
                        rows += [(*now, *r) for r in cutter.rest()]
                    now, cutter = (path, block), Cutter(in_string, depth, place, root, begun)
                rows += [(*now, *r) for r in cutter.add(value + "}")]
            yield _records(rows, wanted)
        if cutter is not None:
            yield _records([(*now, *r) for r in cutter.rest()], wanted)

    return run


def _records(rows: list[tuple], wanted: bool) -> pa.RecordBatch:
    columns = list(zip(*[r[:4] for r in rows if r[4] == wanted])) or [()] * 4
    kinds = pa.string(), pa.int64(), pa.int32(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "block", "place", "text"])


def read_json_arrays(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """(path, place, record) of every record of the JSON arrays in ``paths`` (files or patterns).

    ``place`` counts an array's elements from 0. An object at the top of a file counts as an
    array of one; an empty file or array gives no rows, and neither does a file that begins
    with anything else. A null element is a null record; an element that does not fit the
    schema has nulls, and its neighbours are as they stand. What a query doesn't ask of the
    records is not parsed.

    Files are read three times: for the states of blocks, for records within blocks and for
    those across them. A task holds one record, and one piece of text up to a closing brace.
    If the session cuts files into other blocks in between, the read fails and can be repeated.
    """
    text = spark.read.option("lineSep", "}").text(paths)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    sums = "path string, block long, first string, out_string boolean, out_depth long, out_commas array<array<long>>, in_string boolean, in_depth long, in_commas array<array<long>>"
    states = written(rows.mapInArrow(_blocks, sums).groupBy("path").applyInPandas(_states, _STATE), "json_blocks")
    groups, out = -(-states.count() // BLOCKS_AT_ONCE) or 1, None
    for g in range(groups):
        mine = lambda never: F.pmod(F.xxhash64("path", never), F.lit(groups)) == g
        # Texts are never null; naming them keeps the filter from choosing files, which would move the blocks.
        known = rows.where(mine(F.col("value").isNull())).join(F.broadcast(states.where(mine(F.lit(False)))), ["path", "block"], "left")
        known = known.select("path", "block", "value", "in_string", "depth", "place", "root", "begun")
        cut = lambda wanted, known=known: known.mapInArrow(_cut(wanted), "path string, block long, place int, text string")
        pieces = cut(False).groupBy("path", "place").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        found = cut(True).select("path", "place", "text").unionByName(pieces.select("path", "place", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))
        out = found if out is None else out.unionByName(found)
    there = out.where(F.col("text").rlike(r"[^\s\x{FEFF}]"))
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # the reader gives paths as they stand in a URL
    return there.select(plain.alias("path"), "place", F.from_json(F.when(~F.col("text").rlike(r"^\s*null\s*$"), F.col("text")), schema).alias("record"))
