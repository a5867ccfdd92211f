"""Repeated passages across documents by sparse suffix arrays.

Suffixes are retained at content-selected positions: minimisers of k-word grams, so that
every passage of ``least`` words holds a retained position that its other occurrences hold
as well. Retained suffixes are sorted (by what follows, and once more by what precedes)
and compared with their neighbours, and matches are extended to the left and right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import bound_batches, discard, drop_worker_caches, materialize, release, worker_cache

#: Words of the shortest passage, and of the grams whose minima are retained.
LEAST, GRAM = 50, 8
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_MOST_KNOWN = 400_000


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(1024, 1 << (n + 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        _POWERS[base] = have
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of each run of anything but ASCII white space, as it stands."""
    known: dict[bytes, int] = worker_cache("passages", dict)
    out = []
    for word in text.encode().split():
        value = known.get(word)
        if value is None:
            value = xxhash.xxh64_intdigest(word)
            if len(known) < _MOST_KNOWN:
                known[word] = value
        out.append(value)
    return np.array(out, np.uint64)


class _Ranges:
    """Hashes of word ranges of one text."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * _powers(_BASE, self.n)[: self.n], out=self.sums[1:])
        self.back = _powers(_INVERSE, self.n)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.back[begin]
        return _mix(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` consecutive values."""
    have = 1
    out = x
    while have * 2 <= width:
        out = best(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(words: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, context hash) of the retained suffixes of a text.

    A position is retained if its gram has the least hash (or ties with it) of some
    ``least`` consecutive words. The context reaches ``least - gram`` words to the left and
    ``least`` to the right, or to the text's ends.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(words) < least:
        return none
    ranges = _Ranges(words)
    at = np.arange(len(words) - gram + 1)
    grams = ranges.of(at, at + gram)
    width = least - gram + 1
    low = _sliding(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    kept = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), width, np.maximum) == grams)
    begin, end = np.maximum(kept - (least - gram), 0), np.minimum(kept + least, len(words))
    context = ranges.of(begin, end) ^ _mix((kept - begin).astype(np.uint64))
    return kept, grams[kept], context


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _anchor_rows(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                counts, places, grams, contexts = [], [], [], []
                for text in some.column("text").to_pylist():
                    words = word_hashes(text or "")
                    p, g, c = anchors(words, least, gram)
                    counts.append(len(words))
                    places.append(p.astype(np.int32))
                    grams.append(g.view(np.int64))
                    contexts.append(c.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("mark"), pa.array(counts, pa.int32()), pa.array(places, _INTS), pa.array(grams, _LONGS), pa.array(contexts, _LONGS)],
                    names=["id", "mark", "n_words", "place", "gram", "context"],
                )

    return run


def _context_rows(least: int, gram: int):
    """For the wanted anchors of each text, the words before (nearest first) and from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                out: list[list] = [[], [], [], [], [], []]
                for text, mark, wanted in zip(*[some.column(c).to_pylist() for c in ("text", "mark", "wanted")], strict=True):
                    words = word_hashes(text).astype("<u4")
                    for w in wanted:
                        p = w["place"]
                        row = (w["gram"], w["context"], mark, w["many"], words[max(0, p - (least - gram)) : p][::-1].tobytes(), words[p : p + least].tobytes())
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)],
                    names=["gram", "context", "mark", "many", "before", "after"],
                )

    return run


_CONTEXT = "gram long, context long, mark long, many boolean, before binary, after binary"


def _matrix(values: list[bytes], width: int, filler: int) -> np.ndarray:
    """Words of contexts in rows of ``width``; what is missing never equals another row's."""
    out = np.empty((len(values), width), np.int64)
    out[:] = -1 - filler - np.arange(len(values))[:, None]
    for row, v in zip(out, values, strict=True):
        row[: len(v) // 4] = np.frombuffer(v, "<u4")
    return out


def _common(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j."""
    differ = m[i] != m[j]
    return np.where(differ.any(1), differ.argmax(1), m.shape[1])


def compare_neighbours(rows: list[dict], least: int, gram: int) -> list[tuple]:
    """(gram, context, reach before, reach after, words before, words after) of each of
    the sorted ``rows`` against its nearest neighbours on both sides that have the same
    gram and stand for another text; (…, 0, 0) where there is none. ``many`` rows stand for
    several texts."""
    n = len(rows)
    key = np.array([[r["gram"], r["mark"]] for r in rows], np.int64).reshape(n, 2)
    many = np.array([r["many"] for r in rows], bool)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]).any(1) | many[1:] | many[:-1]
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    ends = np.append(starts[1:], n)
    before, after = _matrix([r["before"] for r in rows], least - gram, 0), _matrix([r["after"] for r in rows], least, n)
    out = []
    for other in (starts[run] - 1, ends[run]):
        ok = (other >= 0) & (other < n)
        ok[ok] = key[np.flatnonzero(ok), 0] == key[other[ok], 0]
        i = np.flatnonzero(ok)
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left[i], right[i] = _common(before, i, other[i]), _common(after, i, other[i])
        out.append((left, right))
    return [(r["gram"], r["context"], int(a), int(b), int(c), int(d)) for r, a, b, c, d in zip(rows, out[0][0], out[0][1], out[1][0], out[1][1], strict=True)]


_ROW = pa.struct([("gram", pa.int64()), ("context", pa.int64()), ("mark", pa.int64()), ("many", pa.bool_()), ("before", pa.binary()), ("after", pa.binary())])
_FOUND = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("l1", pa.int32()), ("r1", pa.int32()), ("l2", pa.int32()), ("r2", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("edge", pa.list_(_ROW))])
_FOUND_SQL = "gram long, context long, l1 int, r1 int, l2 int, r2 int, part int, kind int, edge array<struct<gram: long, context: long, mark: long, many: boolean, before: binary, after: binary>>"
#: Kinds of rows: neighbours compared; rows of a partition's first run; of its last; what
#: other partitions must know of it.
_INNER, _FIRST, _LAST, _ENDS = range(4)
_AT_ONCE = 1000


def _same_run(a: dict, b: dict) -> bool:
    return a["gram"] == b["gram"] and a["mark"] == b["mark"] and not a["many"] and not b["many"]


def _neighbour_rows(least: int, gram: int):
    """Compare along a sorted partition, batch by batch. The rows of its first and last runs,
    whose other neighbours are in other partitions, are given as they are, and a last row
    has what decides on those neighbours: its first row, the first of its second run, the
    last of its last run but one, and its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        drop_worker_caches()
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        beginning = True
        keep = 0  # rows at the front of ``held`` that have been compared
        first = second = last = but_one = None

        def found(rows: list[tuple], kind: int = _INNER, edge: list[dict | None] | None = None) -> pa.RecordBatch:
            lists = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]
            n = len(lists[0])
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(lists, _FOUND.types, strict=False)], pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([edge] * n, _FOUND.types[8])], schema=_FOUND)

        def edges(rows: list[dict], kind: int) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), _AT_ONCE):
                yield found([(0,) * 6], kind, rows[at : at + _AT_ONCE])

        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                rows = batch.slice(at, 5000).to_pylist()
                if not rows:
                    continue
                held += rows
                first = first or rows[0]
                begun = []
                for r in rows:
                    if last is not None and not _same_run(last, r):
                        but_one, second, beginning = last, second or r, False
                    if beginning:
                        begun.append(r)
                    last = r
                yield from edges(begun, _FIRST)
                cut = len(held) - 1
                while cut > 0 and _same_run(held[cut - 1], held[cut]):
                    cut -= 1
                if cut > keep:
                    yield found(compare_neighbours(held, least, gram)[keep:cut])
                    # One earlier run stays in front, for the run that is held back to look at.
                    back = cut - 1
                    while back > 0 and _same_run(held[back - 1], held[back]):
                        back -= 1
                    held, keep = held[back:], cut - back
        if held:
            if len(held) > keep:
                yield found(compare_neighbours(held, least, gram)[keep:])
            yield from edges(held[keep:], _LAST)
            yield found([(0,) * 6], _ENDS, [first, second, but_one, last])

    return run


def _beyond(ends: dict[int, list]) -> dict[int, tuple[dict | None, dict | None]]:
    """For each partition the rows next to its first run and to its last one, in the nearest
    partitions that do not continue these runs."""
    parts, out = sorted(ends), {}
    for at, part in enumerate(parts):
        first, _, _, last = ends[part]
        left = right = None
        for q in reversed(parts[:at]):
            left = ends[q][2] if _same_run(ends[q][3], first) else ends[q][3]
            if left is not None:
                break
        for q in parts[at + 1 :]:
            right = ends[q][1] if _same_run(last, ends[q][0]) else ends[q][0]
            if right is not None:
                break
        out[part] = left, right
    return out


def _edge_rows(beyond: dict[int, tuple[dict | None, dict | None]], least: int, gram: int):
    """(gram, context, l1, r1, 0, 0) of the rows of first and last runs against the rows next
    to them in other partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            for part, kind, rows in zip(*[batch.column(c).to_pylist() for c in ("part", "kind", "edge")], strict=True):
                other = beyond[part][0 if kind == _FIRST else 1]
                rows = [r for r in rows if other is not None and r["gram"] == other["gram"]]
                if not rows:
                    continue
                i, j = np.arange(len(rows)), np.full(len(rows), len(rows))
                left = _common(_matrix([r["before"] for r in [*rows, other]], least - gram, 0), i, j)
                right = _common(_matrix([r["after"] for r in [*rows, other]], least, len(rows) + 1), i, j)
                none = pa.array([0] * len(rows), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["gram"] for r in rows], pa.int64()), pa.array([r["context"] for r in rows], pa.int64()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), none, none],
                    names=["gram", "context", "l1", "r1", "l2", "r2"],
                )

    return run


def _along(contexts: DataFrame, order: list[str], least: int, gram: int, tag: str) -> DataFrame:
    """(gram, context, l1, r1, l2, r2) of the contexts sorted by ``order``.

    The sort is dealt out by ranges of the whole order, so that a gram of very many
    suffixes is shared by many tasks. Of each task four rows come to the driver, which
    says what stands next to its first and last runs; these are compared with that where
    they are, in a second pass.
    """
    spark = contexts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = contexts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    got = materialize(sorted_.mapInArrow(_neighbour_rows(least, gram), _FOUND_SQL), tag)
    ends = {r["part"]: [x and x.asDict() for x in r["edge"]] for r in got.where(F.col("kind") == _ENDS).select("part", "edge").collect()}
    columns = ["gram", "context", "l1", "r1", "l2", "r2"]
    inner = got.where(F.col("kind") == _INNER).select(*columns)
    if len(ends) < 2:
        return inner
    edges = got.where(F.col("kind").isin(_FIRST, _LAST)).select("part", "kind", "edge")
    return inner.unionByName(edges.mapInArrow(_edge_rows(_beyond(ends), least, gram), "gram long, context long, l1 int, r1 int, l2 int, r2 int"))


def _window_rows(least: int):
    """Hashes of windows of ``least`` words through an anchor, by the words before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for r in batch.to_pylist():
                for o in r["offsets"]:
                    value = xxhash.xxh64_intdigest(r["before"][: 4 * o] + b"|" + r["after"][: 4 * (least - o)]) - (1 << 63)
                    for column, x in zip(out, (r["gram"], r["context"], r["mark"], r["many"], r["open"], o, value), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["gram", "context", "mark", "many", "open", "o", "value"])

    return run


def _open_windows(around: DataFrame, reach: DataFrame, least: int) -> DataFrame:
    """(gram, context, reach) of the windows that the sorted orders left open.

    No match of an anchor reaches farther than the longest on each side. Where a match that
    makes up a passage reaches as far on both sides, all is known. Else the windows that
    reach farther than these, but not farther than the longest, are hashed; and those of
    all anchors of the same gram that have them, too, for comparison.
    """
    most = lambda side: F.coalesce(F.array_max(F.transform("reach", lambda s: s[side])), F.lit(-1))
    first, last = least - F.col("far_r"), F.col("far_l")
    ranges = reach.where(F.col("far_r") + F.col("far_l") >= least).select("gram", "context", "far_l", "far_r", F.greatest(most("l") + 1, first).alias("a"), F.least(least - most("r") - 1, last).alias("b"), first.alias("first"), last.alias("last"))
    part = lambda x, y: F.when(F.col(x) <= F.col(y), F.sequence(x, y)).otherwise(F.expr("cast(array() as array<int>)"))
    ranges = ranges.select("gram", "context", "far_l", "far_r", F.array_union(part("a", "last"), part("first", "b")).alias("wanted"))
    asked = ranges.where(F.size("wanted") > 0).groupBy("gram").agg(F.array_distinct(F.flatten(F.collect_set("wanted"))).alias("asked"))
    offsets = F.filter("asked", lambda o: (o <= F.col("far_l")) & (least - o <= F.col("far_r")))
    rows = ranges.join(asked, "gram").select("gram", "context", offsets.alias("offsets"), (F.size("wanted") > 0).alias("open")).where(F.size("offsets") > 0)
    hashed = around.join(rows, ["gram", "context"]).mapInArrow(_window_rows(least), "gram long, context long, mark long, many boolean, open boolean, o int, value long")
    hashed = materialize(hashed, "windows")
    shared = hashed.groupBy("gram", "o", "value").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.max("many").alias("many")).where("low <> high or many")
    found = hashed.where("open").join(shared.select("gram", "o", "value"), ["gram", "o", "value"])
    ends = F.array(F.struct(F.max("o").alias("l"), F.lit(0).alias("r")), F.struct(F.lit(0).alias("l"), F.max(least - F.col("o")).alias("r")))
    return found.groupBy("gram", "context").agg(ends.alias("reach"))


def _merged(spans):
    """Union of the [begin, end) intervals of an array of struct(a, b), as a flat array."""
    return F.aggregate(
        F.array_sort(spans),
        F.expr("cast(array() as array<int>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= s["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), s["b"])))).otherwise(F.concat(acc, F.array(s["a"], s["b"]))),
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per document with repeated passages: (id, n_words, n_repeated, spans).

    ``spans`` is a flat array [begin, end, begin, end, ...) in words (runs of anything but
    ASCII white space, compared as they stand): the union of all runs of ``least`` words
    or more that also stand in another document. Documents without any have no row. Texts
    that repeat only within one document do not count; null, empty and shorter texts have
    no passage. Repeated rows are documents of their own, so their whole text is repeated.
    Ids may be null or repeated.

    Equal texts are worked on once. Of a text's anchors, those whose whole context stands
    in other texts need no comparison; for the rest the contexts (at most
    ``2 * least - gram`` words of four bytes) are fetched and sorted. Neighbours in the sort
    by what follows have the longest match to the right, those in the sort by what precedes
    the longest to the left; what these leave open is decided by windows' hashes.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    per_doc = materialize(rows.mapInArrow(_anchor_rows(least, gram), f"id {docs.schema[id_col].dataType.simpleString()}, mark long, n_words int, place array<int>, gram array<long>, context array<long>"), "anchors")
    long_ = per_doc.where(F.col("n_words") >= least)
    texts = long_.groupBy("mark").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("n_words").alias("n_words"), F.first(F.struct("place", "gram", "context")).alias("a"))
    texts = materialize(texts.select("mark", "copies", "first", "n_words", "a.*"), "texts")
    every = texts.select("mark", "first", F.explode(F.arrays_zip("place", "gram", "context")).alias("a")).select("mark", "first", "a.*")
    contexts = every.groupBy("gram", "context").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.min(F.struct("mark", "place", "first")).alias("one"))
    contexts = materialize(contexts, "contexts")
    grams = contexts.groupBy("gram").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count_if(F.col("low") == F.col("high")).alias("alone"))
    open_ = grams.where("least <> most and alone > 0").select("gram")
    wanted = contexts.join(open_, "gram").select("one.mark", "one.first", F.struct("one.place", "gram", "context", (F.col("low") != F.col("high")).alias("many")).alias("w"))
    wanted = wanted.groupBy("mark", "first").agg(F.collect_list("w").alias("wanted"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("of"))
    fetched = wanted.join(source, wanted["first"].eqNullSafe(source["id"]) & (wanted["mark"] == source["of"]))
    fetched = fetched.select("text", "mark", "wanted").mapInArrow(_context_rows(least, gram), _CONTEXT)
    around = materialize(fetched, "around")
    release(docs.sparkSession)
    right = _along(around, ["gram", "after", "before", "mark"], least, gram, "right")
    left = _along(around, ["gram", "before", "after", "mark"], least, gram, "left")
    reach = right.select("*", F.greatest("r1", "r2").alias("far_r"), F.lit(0).alias("far_l")).unionByName(left.select("*", F.lit(0).alias("far_r"), F.greatest("l1", "l2").alias("far_l")))
    good = F.filter(F.array(*[F.struct(F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")) for i in (1, 2)]), lambda s: s["l"] + s["r"] >= least)
    reach = reach.groupBy("gram", "context").agg(F.array_distinct(F.flatten(F.collect_list(good))).alias("reach"), F.max("far_r").alias("far_r"), F.max("far_l").alias("far_l"))
    reach = materialize(reach, "reach")
    release(docs.sparkSession)
    exact = _open_windows(around, reach, least)
    whole = contexts.where("low <> high").select("gram", "context", F.array(F.struct(F.lit(least - gram).alias("l"), F.lit(least).alias("r"))).alias("reach"))
    matched = reach.where(F.size("reach") > 0).select("gram", "context", "reach").unionByName(exact).unionByName(whole)
    hits = every.join(matched, ["gram", "context"]).select("mark", "place", F.explode("reach").alias("s"))
    spans = hits.select("mark", F.greatest(F.col("place") - F.col("s.l"), F.lit(0)).alias("a"), (F.col("place") + F.col("s.r")).alias("b"))
    spans = spans.groupBy("mark").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = texts.select("mark", "copies", "n_words").join(spans, "mark", "left").where("copies > 1 or spans is not null")
    clipped = F.transform("spans", lambda s: F.struct(s["a"].alias("a"), F.least(s["b"], F.col("n_words")).alias("b")))
    joined = joined.select("mark", F.when(F.col("copies") > 1, F.array(F.lit(0), F.col("n_words"))).otherwise(_merged(clipped)).alias("spans"))
    out = per_doc.select("id", "mark", "n_words").where(F.col("n_words") >= least).join(joined, "mark")
    size = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return out.select(F.col("id").alias(id_col), "n_words", size.alias("n_repeated"), "spans")
