"""Benchmark decontamination by a prefix-filtered join over item-sized windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bound_batches, drop_worker_caches, materialize, pieces

WINDOW = 13
SHINGLE = 3
#: Bytes of benchmark text that one index, sent to all tasks, may be made of.
INDEX_BYTES = 16 << 20
_CHUNK = 1 << 20
#: Bytes of documents that are searched together.
_TOGETHER = 2 << 20
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.encode().translate(_WORDS).split() if text else []


class WindowIndex:
    """The distinct windows of benchmark items, found by their rarest shingle.

    A window is ``window`` consecutive words of an item, or a whole shorter item. Shingles
    are ``SHINGLE`` consecutive words (fewer in windows shorter than that). Containment of
    all of a window's shingles makes its necessary prefix one shingle long: the rarest.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        places: dict[tuple[int, ...], int] = {}
        owners: set[tuple[int, int]] = set()
        self.items: list[str | None] = []
        number: dict[str | None, int] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            if item not in number:
                number[item] = len(self.items)
                self.items.append(item)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1):
                owners.add((places.setdefault(tuple(ids[at : at + n]), len(places)), number[item]))
        if len(self.vocabulary) >= 1 << 21:
            raise ValueError("too many distinct words for one index; lower index_bytes")
        self.windows = list(places)
        pairs = np.array(sorted(owners), np.int64).reshape(-1, 2)
        self.owner_starts = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.owner_items = pairs[:, 1]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.flat = np.array([i for w in self.windows for i in w], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: Of each shingle length: all distinct shingles, sorted.
        self.shingles: dict[int, np.ndarray] = {}
        self._of_window: list[list[int]] = []
        per: dict[int, set[int]] = {}
        for w in self.windows:
            s = min(SHINGLE, len(w))
            keys = [_key(w[i : i + s]) for i in range(len(w) - s + 1)]
            self._of_window.append(keys)
            per.setdefault(s, set()).update(keys)
        for s, keys in per.items():
            self.shingles[s] = np.array(sorted(keys), np.int64)

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Fix the prefix of each window: its shingle with the least count (ties: the
        least shingle), counts being over all documents."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for w, keys in enumerate(self._of_window):
            s = min(SHINGLE, len(self.windows[w]))
            at = min(range(len(keys)), key=lambda i: (counts.get((s, keys[i]), 0), keys[i]))
            found.setdefault(s, []).append((keys[at], w, at))
        del self._of_window, self.shingles, self.windows  # what workers need is in arrays
        self.prefix = {}
        for s, rows in found.items():
            rows = np.array(sorted(rows), np.int64)
            self.prefix[s] = (*np.unique(rows[:, 0], return_index=True), rows[:, 1], rows[:, 2])


def _key(ids) -> int:
    out = 0
    for i in ids:
        out = out << 21 | i
    return out


def _ids(texts: pa.Array, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts in one array, each text followed by a 0, and words per text.
    Words of no item are 0, too, so that no shingle reaches over them or a text's end."""
    rows, counts = [], []
    for text in texts:
        words = words_of(text.as_py())
        counts.append(len(words))
        rows.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words)))
        rows.append(np.zeros(1, np.int64))
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array(counts, np.int64)


def _shingles(ids: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, shingle) wherever ``s`` consecutive words all are words of items."""
    n = len(ids) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = ids[:n] > 0
    for k in range(1, s):
        ok &= ids[k : n + k] > 0
    at = np.flatnonzero(ok)
    out = np.zeros(len(at), np.int64)
    for k in range(s):
        out = out << 21 | ids[at + k]
    return at, out


class _Shingles(NamedTuple):
    """What counting needs of an index."""

    vocabulary: dict[bytes, int]
    shingles: dict[int, np.ndarray]


def _counter(index: _Shingles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        sums = {s: np.zeros(len(keys), np.int64) for s, keys in index.shingles.items()}
        for batch in batches:
            for some in pieces(batch, 0, _TOGETHER):
                ids, _ = _ids(some.column(0), index.vocabulary)
                for s, keys in index.shingles.items():
                    _, got = _shingles(ids, s)
                    place = np.searchsorted(keys, got)
                    place[place == len(keys)] = 0
                    sums[s] += np.bincount(place[keys[place] == got], minlength=len(keys))
        for s, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(index.shingles[s][some]), pa.array(n[some])], names=["s", "shingle", "n"])

    return run


def match(ids: np.ndarray, ends: np.ndarray, index: WindowIndex) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence in ``ids``, whose texts end before ``ends``.

    Candidates are where a window's prefix shingle stands. The prefix's place in the window
    bounds the occurrence's start from below and its length bounds the end, both inside the
    text; what is left is compared word by word.
    """
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begins = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    for s, (keys, first, which, offset) in index.prefix.items():
        at, got = _shingles(ids, s)
        place = np.searchsorted(keys, got)
        place[place == len(keys)] = 0
        hit = keys[place] == got
        at, place = at[hit], place[hit]
        many = np.append(first, len(which))
        lots = many[place + 1] - many[place]
        cuts = np.searchsorted(np.cumsum(lots), np.arange(_CHUNK, lots.sum() + _CHUNK, _CHUNK))
        for a, b in zip(np.concatenate(([0], cuts)), np.append(cuts, len(at)), strict=True):
            n = lots[a:b]
            if not n.sum():
                continue
            row = np.repeat(many[place[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = which[row]
            begin = np.repeat(at[a:b], n) - offset[row]
            text = np.searchsorted(ends, np.repeat(at[a:b], n))
            ok = (begin >= begins[text]) & (begin + index.lengths[w] <= ends[text])
            w, begin = w[ok], begin[ok]
            for k in range(int(index.lengths[w].max()) if len(w) else 0):
                inside = k < index.lengths[w]
                same = ~inside | (ids[begin + np.where(inside, k, 0)] == index.flat[index.starts[w] + np.where(inside, k, 0)])
                w, begin = w[same], begin[same]
            starts.append(begin)
            windows.append(w)
    return np.concatenate(starts), np.concatenate(windows)


def _finder(index: WindowIndex):
    """Per text: n_words, the merged hit intervals [begin, end) and the items' ids."""
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            for some in pieces(batch, batch.num_columns - 1, _TOGETHER):
                *others, texts = some.columns
                ids, counts = _ids(texts, index.vocabulary)
                ends = np.cumsum(counts + 1) - 1
                at, window = match(ids, ends, index)
                step = np.zeros(len(ids) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + index.lengths[window], -1)
                hit = np.diff(np.concatenate(([0], (np.cumsum(step) > 0).astype(np.int8))))
                up, down = np.flatnonzero(hit > 0), np.flatnonzero(hit < 0)
                base = np.concatenate(([0], ends[:-1] + 1))
                of = np.searchsorted(ends, up)
                spans: list[list[int]] = [[] for _ in texts]
                for t, a, b in zip(of.tolist(), (up - base[of]).tolist(), (down - base[of]).tolist(), strict=True):
                    spans[t] += (a, b)
                items: list[set] = [set() for _ in texts]
                doc = np.searchsorted(ends, at)
                for t, w in np.unique(np.stack([doc, window], 1), axis=0).tolist():
                    items[t].update(index.owner_items[index.owner_starts[w] : index.owner_starts[w + 1]].tolist())
                named = [sorted(index.items[i] for i in x if index.items[i] is not None) for x in items]
                yield pa.RecordBatch.from_arrays(
                    [*others, pa.array(counts), pa.array(spans, kind), pa.array(named, pa.list_(pa.string()))],
                    names=[*batch.schema.names[:-1], "n_words", "spans", "items"],
                )

    return run


def _build(rows: list, texts: DataFrame, window: int) -> WindowIndex:
    index = WindowIndex([(r[0], r[1]) for r in rows], window)
    counted = texts.mapInArrow(_counter(_Shingles(index.vocabulary, index.shingles)), "s int, shingle long, n long").groupBy("s", "shingle").agg(F.sum("n").alias("n"))
    index.choose({(r[0], r[1]): r[2] for r in counted.collect()} if index.windows else {})
    return index


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> list[DataFrame]:
    """(item, text) of ``benchmark`` in blocks of about ``index_bytes`` of text or less,
    by a hash of the row: one, unless the benchmark is large."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // index_bytes)) if size > index_bytes else 1
    if n == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: its ``keep`` columns, n_words, n_hit, spans, items.

    ``spans`` are the merged word intervals [begin, end, begin, end, ...) under occurrences
    of windows, ``n_hit`` their words, ``items`` the sorted ids of the items that have
    occurring windows. Frequencies of the benchmark's shingles are counted over all
    documents; what comes to the driver is bounded by the benchmark's block. A benchmark
    beyond ``index_bytes`` is taken in blocks, all of them against all documents, and
    their intervals are merged, so the result does not depend on it. Null or empty texts
    have no words; items without words have no window; an item with a null id marks words
    but is not listed; repeated rows count each.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, index_bytes)
    kept = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    head = ", ".join(f"k{i} {kept.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    schema = f"{head}{', ' * bool(head)}n_words long, spans array<int>, items array<string>"
    if len(blocks) == 1:
        out = kept.mapInArrow(_finder(_build(blocks[0].collect(), texts, window)), schema)
    else:
        marked = kept.select(F.xxhash64("text").alias("mark"), *[f"k{i}" for i in range(len(keep))], "text")
        parts = [marked.mapInArrow(_finder(_build(b.collect(), texts, window)), f"mark long, {schema}").withColumn("block", F.lit(i)) for i, b in enumerate(blocks)]
        out = _merge_blocks(parts, ["mark", *[f"k{i}" for i in range(len(keep))]])
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", hit.cast("long").alias("n_hit"), "spans", "items")


def _merge_blocks(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Unite the intervals and items of the same row over blocks. Rows with equal keys and
    text have equal results in each block, so any numbering tells them apart."""
    from pyspark.sql import Window

    every = materialize(parts[0], "block0")
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(materialize(p, f"block{i}"))
    place = Window.partitionBy("block", *keys).orderBy("n_words")
    every = every.withColumn("place", F.row_number().over(place))
    flat = F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.floor(F.size("spans") / 2).cast("int")), lambda i: F.struct(F.get("spans", 2 * i).alias("a"), F.get("spans", 2 * i + 1).alias("b")))))
    got = every.groupBy(*keys, "n_words", "place").agg(F.array_sort(F.filter(flat, lambda s: s["a"].isNotNull())).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        "all",
        F.expr("cast(array() as array<int>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= s["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), s["b"])))).otherwise(F.concat(acc, F.array(s["a"], s["b"]))),
    )
    return got.select(*keys, "n_words", joined.alias("spans"), "items")


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The rule: any word hit, and a twentieth of the words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def digest(items: list[str]) -> str:
    """Lower-case hex SHA-256 of sorted ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
