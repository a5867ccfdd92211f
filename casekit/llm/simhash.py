"""Near-duplicates by SimHash with multi-index hashing.

Fingerprints enter one table per segment; small Hamming balls around each segment are looked
up, and what is found is verified on complete distances. Two ways are built on that: links
of 64-bit fingerprints within a few bits, which are exact, and links of texts by the Jaccard
similarity of their shingles, whose longer fingerprints give candidates for an exact check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ._common import bound_batches, discard, drop_worker_caches, likely, materialize, release
from .components import connected_components, near_labels

#: (lowest bit, width, radius) of each segment. The radii plus one sum to one more than
#: the distance: two fingerprints that differ in at most 4 bits are within its radius in
#: at least one segment (else they would differ in 1 + 2 + 2 bits).
SEGMENTS = ((0, 21, 0), (21, 21, 1), (42, 22, 1))
DISTANCE = 4
_ROWS = 1 << 16
#: Words of a shingle and least Jaccard similarity of near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Share of the pairs at the least similarity that the tables may miss (of more similar
#: pairs they miss far fewer), and standard deviations that distances may exceed their mean.
MISSED, DEVIATIONS = 0.002, 4.5
#: Tables by which large groups are linked as stars, times that this is done at most, and
#: least size of a component whose members are not paired with each other again.
STAR_TABLES, STAR_ROUNDS, LARGE = 8, 2, 8
#: Bits of a segment that a key leaves out, at most.
OPEN = 6
#: Bits of a set's odd sketch, and members of a key above which they are held against each
#: other by their sketches where they meet: as many as chance brings together at most.
ODD_BITS, CROWD = 512, 1 << OPEN
#: Tables whose entries move at once, so that no step's shuffles hold all.
AT_ONCE = 14
#: Members of a large component whose keys are counted together.
_TOGETHER = 500
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BYTES, _WORDS = np.random.default_rng(8).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        out = np.full(1 << (n + 1).bit_length(), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * _BLOCK:
            _POWERS[base] = have
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _spans(text: str | None, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of ``text`` joined by spaces, and where its shingles begin and end."""
    found = text.encode().lower().split() if text else []
    if not found:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    return b" ".join(found), starts[:n], ends[min(words, len(found)) - 1 :]


def shingles(text: str | None, words: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The distinct 64-bit hashes (uint64, ascending) of the shingles of whole ``text``, as
    ``fingerprint`` takes them; none for a null text or one without words. The hash is a
    mixed polynomial in the bytes, which sums before and after a shingle give."""
    data, starts, ends = _spans(text, words)
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    back = pow(_BASE, -1, 1 << 64)
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + _BLOCK)))
        high = int(ends[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[raw[low:high]] * _powers(_BASE, high - low)[: high - low], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out.append(_mix((sums[b] - sums[a]) * _powers(back, high - low)[a] + (b - a + seed).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = to
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def long_fingerprint(values: np.ndarray, n_words: int) -> np.ndarray:
    """SimHash in ``n_words`` times 64 bits (int64) of a set of shingles: a bit is set if it
    is set in over half of the hashes, which are mixed anew for each 64 bits."""
    hits = np.zeros(64 * n_words, np.int64)
    for at in range(0, len(values), 255 * 64):
        mixed = values[at : at + 255 * 64, None] * _WORDS[:n_words] if n_words <= len(_WORDS) else values[at : at + 255 * 64, None] * _powers(_BASE, n_words)[1 : n_words + 1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        for k in range(0, len(bits), 255):  # eight sums of up to 255 fit one lane each
            hits += np.add.reduce(bits[k : k + 255], axis=0).view(np.uint8)
    return np.packbits(2 * hits > len(values), bitorder="little").view(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """``ODD_BITS`` bits (int64): whether an odd number of the shingles falls on each. Two
    sets' sketches differ in no more bits than the sets have shingles that are in one only."""
    hits = np.bincount((values >> np.uint64(20) & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS)
    return np.packbits(hits & 1, bitorder="little").view(np.int64)


def _may_be_similar(a: Column, b: Column, n: Column, similarity: float) -> Column:
    """Whether sets of ``n`` shingles together can have that similarity, by their odd sketches."""
    apart = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(ODD_BITS // 64)]
    return sum(apart[1:], apart[0]) * (1 + similarity) <= n * (1 - similarity) + 1e-6


class Plan(NamedTuple):
    """How texts are looked up: ``n_words`` words of fingerprint, each cut in ``per``
    segments of ``width`` bits; balls have radius 1. ``differ`` is the share of bits in
    which sets at the least similarity differ."""

    width: int
    per: int
    n_words: int
    differ: float

    @property
    def tables(self) -> int:
        return self.per * self.n_words

    def most(self, bits: int) -> int:
        """Bits in which so many of similar sets may differ."""
        return math.ceil(bits * self.differ + DEVIATIONS * math.sqrt(bits * self.differ * (1 - self.differ)))


def plan_tables(n_texts: int, similarity: float = SIMILARITY, missed: float = MISSED) -> Plan:
    """Segments as wide as ``n_texts`` asks for, so that an entry of a table meets about as
    many others by chance at any size, and as many tables as bound what is ``missed``.

    Sets at a Jaccard similarity J have a cosine of 2 J / (1 + J) or more, and a bit of
    their fingerprints differs with the chance of their angle over pi.
    """
    differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    width = min(31, max(10, (max(n_texts, 1) - 1).bit_length()))
    hit = (1 - differ) ** width + width * differ * (1 - differ) ** (width - 1)
    tables = math.ceil(math.log(missed) / math.log1p(-min(hit, 0.999)))
    return Plan(width, 64 // width, -(-tables // (64 // width)), differ)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _shingle_rows(words: int, seed: int, n_words: int):
    """Batches whose last column is a text to the other columns and fp (a hash of the set of
    shingles), n (their number), and a fingerprint of ``n_words`` words with the odd sketch
    or, if that is 0, the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                *others, texts = some.columns
                sets = [shingles(t.as_py(), words, seed) for t in texts]
                fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), seed) for x in sets], np.uint64).view(np.int64)
                sizes = pa.array([len(x) for x in sets], pa.int32())
                found = [long_fingerprint(x, n_words) if n_words else x.view(np.int64) for x in sets]
                odd = {"odd": _lists([odd_sketch(x) for x in sets])} if n_words else {}
                yield pa.RecordBatch.from_arrays([*others, pa.array(fps), sizes, _lists(found), *odd.values()], names=[*some.schema.names[:-1], "fp", "n", "found", *odd])

    return run


def _similar(pairs: DataFrame, codes: DataFrame, texts: DataFrame, plan: Plan, words: int, seed: int, similarity: float) -> DataFrame:
    """Those of the candidate pairs (u, v) whose complete fingerprints are near each other,
    whose odd sketches allow it, and whose whole sets of shingles are similar enough."""
    pairs = materialize(pairs.distinct(), "pairs")
    side = lambda name: codes.select(F.col("fp").alias(name), F.col("hash").alias(f"h_{name}"), F.col("found").alias(f"c_{name}"), F.col("odd").alias(f"odd_{name}"), F.col("n").alias(f"n_{name}"))
    a, b = side("u"), side("v")
    may = _may_be_similar(F.col("odd_u"), F.col("odd_v"), F.col("n_u") + F.col("n_v"), similarity)
    apart = F.aggregate(F.zip_with("c_u", "c_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = materialize(pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where(may & (apart <= plan.most(64 * plan.n_words))).select("u", "v", "h_u", "h_v"), "near")
    need = materialize(near.select(F.explode(F.array(F.struct(F.col("u").alias("fp"), F.col("h_u").alias("hash")), F.struct(F.col("v").alias("fp"), F.col("h_v").alias("hash")))).alias("x")).select("x.*").distinct(), "need")
    again = likely(texts, "hash", need).mapInArrow(_shingle_rows(words, seed, 0), "hash long, fp long, n int, found array<long>")
    sets = materialize(again.select("fp", "found").join(need.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("found").alias("found")), "sets")
    a, b = (sets.select(F.col("fp").alias(x), F.col("found").alias(y)) for x, y in ("ua", "vb"))
    both = F.size(F.array_intersect("a", "b"))
    out = materialize(near.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where(both >= similarity * (F.size("a") + F.size("b") - both)).select("u", "v"), "similar")
    for done in (pairs, near, need, sets):
        discard(done)
    release(out.sparkSession)
    return out


def _segments(plan: Plan, tables: Sequence[int]) -> Column:
    """Array of the keys (table and segment, in one long) of some tables."""
    mask = F.lit((1 << plan.width) - 1)
    cut = lambda t: F.shiftrightunsigned(F.col("found")[t // plan.per], t % plan.per * plan.width).bitwiseAND(mask)
    return F.array(*[cut(t) + F.lit(t << 40) for t in tables])


def _blocks(plan: Plan) -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks of a segment: segments that differ in one bit at
    most agree on all of it but one block."""
    n = -(-plan.width // OPEN)
    cuts = [plan.width * i // n for i in range(n + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)]


def _opened(plan: Plan, classes: Sequence[tuple[Column, int]]) -> Column:
    """Rows of a segment's ``key``: for each block one (key, part) in each class of size, with
    the block left out of the key, and the block's bits plus a mark as the part."""
    out = []
    for i, (low, bits) in enumerate(_blocks(plan)):
        mask = (1 << bits) - 1
        key = F.col("key").bitwiseAND(F.lit(~(mask << low))) + F.lit(i << 36)
        part = F.shiftrightunsigned("key", low).bitwiseAND(F.lit(mask))
        out += [F.struct((key + at * (1 << 48)).alias("key"), (part + F.lit(mark)).cast("short").alias("part")) for at, mark in classes]
    return F.explode(F.array(*out)).alias("x")


def shingle_links(texts: DataFrame, marked: DataFrame, plan: Plan, words: int = SHINGLE, seed: int = 42, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between sets of shingles that join sets of at least that Jaccard
    similarity, directly or through others. ``marked`` has rows (fp, n, found, odd, hash) with
    the fingerprint and odd sketch of each of ``texts`` (hash, text).

    Fingerprints are candidates if a segment of theirs differs in one bit at most and their
    classes of size are the same or next to each other. A Hamming ball of radius 1 is looked
    up by blocks of the segment: a fingerprint enters a table once for each of its segment's
    blocks, with the block left out of the key, and what shares a key is held against the
    block's bits and against 64 bits inside the join. A block has ``OPEN`` bits at most, so
    that rows a fingerprint grow with the tables and their width only, and those that share
    a key by chance stay as many at any size. What is found is held against the complete
    fingerprint and the sets after it; shingles are made again for texts that come so far only.

    Large groups come first: in ``STAR_ROUNDS`` rounds at most every member of a key in the
    first tables meets one of its members, that of the least or the greatest component in
    turn, so that a group costs links in proportion to its size; classes of size are moved by
    half a class in turn, so that no group stays cut by one. Members of components of ``LARGE``
    sets or more then meet all others, but not those of the same component: where a key holds
    several such components, all members but those of the commonest one meet the whole key,
    and that one's members meet the others. Where unlike sets crowd together, as many variants
    of one text do that are just not similar enough, members of a key with over ``CROWD`` of
    them carry their odd sketches, which drop pairs inside the join that can't be similar.
    """
    scale = F.log(F.col("n")) / math.log(1 / similarity) if similarity < 1 else F.col("n").cast("double")
    each = marked.where("n > 0").groupBy("fp").agg(F.min("hash").alias("hash"), F.first("n").alias("n"), F.first("found").alias("found"), F.first("odd").alias("odd"))
    classes = [F.floor(scale + shift).cast("long").alias(name) for shift, name in ((0, "size"), (0.5, "moved"))]
    codes = materialize(each.select("*", *classes, F.col("found")[0].alias("head")), "codes")
    near64 = F.bit_count(F.col("head_u").bitwiseXOR(F.col("head_v"))) <= plan.most(64)
    links = roots = crowd = None

    def check(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, codes, texts, plan, words, seed, similarity)

    def placed(rows: DataFrame, node: str = "fp") -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col(node)).withColumn("large", F.lit(False))
        return rows.join(roots.hint("merge"), rows[node] == roots["node"], "left").select(*rows.columns, F.coalesce("root", node).alias("root"), F.coalesce("large", F.lit(False)).alias("large"))

    for turn in range(STAR_ROUNDS):
        now = placed(codes.select("fp", "head", F.col("moved" if turn % 2 else "size").alias("size"), "found"))
        now = now.select("fp", "head", "root", "size", F.explode(_segments(plan, range(min(STAR_TABLES, plan.tables)))).alias("key"))
        now, one = now.select("fp", "head", "root", _opened(plan, [(F.col("size"), 0)])).select("fp", "head", "root", "x.key"), F.struct("root", "fp", "head")
        hub = now.groupBy("key").agg((F.max(one) if turn % 2 else F.min(one)).alias("h"), F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a <> b")
        if crowd is None:
            hub = materialize(hub, "hubs")
            crowd = materialize(now.select("key", "fp").join(hub.where(F.col("n") > CROWD).select("key"), "key").select("fp").distinct().withColumn("crowded", F.lit(True)), "crowd")
        hub = hub.select("key", F.col("h.fp").alias("u"), F.col("h.root").alias("root_u"), F.col("h.head").alias("head_u"))
        met = now.select("key", F.col("fp").alias("v"), F.col("root").alias("root_v"), F.col("head").alias("head_v")).join(hub, "key").where(F.col("root_u") != F.col("root_v")).where(near64)
        more = check(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        links = more if links is None else links.unionByName(more)
        # Labels of the round before are links, too.
        of = near_labels(links if roots is None else links.unionByName(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))))
        grown = of.groupBy("root").agg(F.count("*").alias("size"))
        roots = materialize(of.join(grown.hint("merge"), "root").select("node", "root", (F.col("size") >= LARGE).alias("large"), F.ceil(F.col("size") / _TOGETHER).alias("shares")), "star_roots")
        release(texts.sparkSession)
        if more.isEmpty() or roots.where("large").isEmpty():
            break
    sketch = F.when(F.col("crowded"), F.concat("odd", F.array(F.col("n").cast("long")))).alias("odd")
    now = placed(codes.join(crowd.hint("merge"), "fp", "left").select("fp", "head", "size", "found", sketch))
    now = materialize(now, "placed")
    own, below, above = F.col("size"), F.col("size") - 1, F.col("size") + 1
    # Marks an entry that any may ask for; of two of one class that both ask, the smaller one does.
    any_asks = 1 << 8
    small, large = now.where("not large"), now.where("large")
    # Members of a large component have many keys in common: those of some hundreds are
    # counted where they are together, before they move.
    held = large.join(roots.select(F.col("node").alias("fp"), "shares").hint("merge"), "fp")
    held = held.repartition("root", F.pmod(F.xxhash64("fp"), F.col("shares"))).drop("shares")
    any_large, met = not roots.where("large").isEmpty(), []

    def side(rows: DataFrame, end: str, entered: list, *more: str) -> DataFrame:
        rows = rows.select("fp", "head", "odd", "root", "size", F.explode(_segments(plan, some)).alias("key"))
        rows = rows.select("fp", "head", "odd", *more, _opened(plan, entered))
        return rows.select(*[F.col(c).alias(e) for c, e in (("fp", end), ("head", f"head_{end}"), ("odd", f"odd_{end}"), *[(x, f"{x}_{end}") for x in more])], "x.key", F.col("x.part").alias(f"part_{end}"))

    def meet(ask: DataFrame, into: DataFrame) -> DataFrame:
        differ = F.bit_count(F.col("part_u").bitwiseXOR(F.col("part_v").bitwiseAND(F.lit(any_asks - 1).cast("short"))))
        # Equal segments share the keys of all blocks and meet by the first.
        ball = (differ == 1) | (differ == 0) & (F.col("key").bitwiseAND(F.lit(7 << 36)) == 0)
        a, b, words = F.col("odd_u"), F.col("odd_v"), ODD_BITS // 64
        may = a.isNull() | b.isNull() | _may_be_similar(a, b, a[words] + b[words], similarity)
        found = ask.join(into, "key").where(((F.col("part_v") >= any_asks) | (F.col("u") < F.col("v"))) & ball & near64 & may)
        return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    for first in range(0, plan.tables, AT_ONCE):
        some = range(first, min(plan.tables, first + AT_ONCE))
        entered = side(small, "v", [(own, 0), (below, any_asks)]).unionByName(side(large, "v", [(own, any_asks), (below, any_asks), (above, any_asks)]))
        met.append(materialize(meet(side(small, "u", [(own, 0)]), entered).distinct(), "pairs"))
        release(texts.sparkSession)
        if not any_large:
            continue
        counted = side(held, "v", [(own, 0), (below, 0)], "root").groupBy("key", "root_v").agg(F.count("*").alias("n"))
        many = counted.groupBy("key").agg(F.max(F.struct("n", "root_v")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
        many = materialize(many.select("key", F.col("most.root_v").alias("most")), "many")
        if not many.isEmpty():
            asked = side(large, "u", [(own, 0)], "root").join(many, "key")
            into = side(large, "v", [(own, 0), (below, any_asks)], "root").join(many, "key")
            both = meet(asked.where("root_u <> most").drop("most"), into.drop("most"))
            both = both.unionByName(meet(asked.where("root_u = most").drop("most"), into.where("root_v <> most").drop("most")))
            met.append(materialize(both.distinct(), "pairs"))
        discard(many)
        release(texts.sparkSession)
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    known = placed(placed(pairs, "u").select("u", "v", F.col("root").alias("root_u")), "v").where(F.col("root_u") != F.col("root")).select("u", "v")
    links = links.unionByName(check(known))
    for done in (codes, crowd, now, *met):
        discard(done)
    release(texts.sparkSession)
    return links


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of whole ``text`` as a signed 64-bit integer.

    ASCII letters are lower-cased; words are runs of anything but ASCII white space. Each
    shingle of ``words`` words (the whole sequence if there are fewer), joined by spaces,
    counts as often as it occurs. A bit is set if it is set in over half the XXH64 values.
    A null text, or one without words, has fingerprint 0.
    """
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    data = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    digest, hits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _ROWS):
        some = slice(at, min(n, at + _ROWS))
        last = ends[min(words - 1, len(found) - 1) :][some]
        values = [digest(data[a:b], seed) for a, b in zip(starts[some].tolist(), last.tolist(), strict=False)]
        bits = np.unpackbits(np.array(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hits += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * hits > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column | str, words: int = 4, seed: int = 42) -> Column:
    """``fingerprint`` as a column of type long; nulls give 0."""

    @pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        drop_worker_caches()
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return fp(text)


def fingerprint_hex(value: Column | str) -> Column:
    """The 16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _balls(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _segment(fp: str, low: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << width) - 1))


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _probe(segment: int, at: Column):
    return lambda mask: F.struct(F.lit(segment).alias("segment"), at.bitwiseXOR(mask).alias("value"))


def _stars(fps: DataFrame, segments, distance: int) -> DataFrame:
    """(fp, scheme, hub): for each segment but one left out, the least fingerprint that
    agrees on all the others, where it is within the distance. Linear in a group's size."""
    keys = []
    for i, (low, width, _) in enumerate(segments):
        rest = ~(((1 << width) - 1) << low) & (1 << 64) - 1
        keys.append(F.struct(F.lit(i).alias("scheme"), F.col("fp").bitwiseAND(F.lit(rest - (1 << 64) if rest >> 63 else rest)).alias("key")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.scheme", "k.key")
    hubs = rows.groupBy("scheme", "key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    near = rows.join(hubs, ["scheme", "key"])
    return near.where(_differ("fp", "hub") <= distance).select("fp", "scheme", "hub")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, segments: Sequence[tuple[int, int, int]] = SEGMENTS) -> DataFrame:
    """Links (u, v) that join every two fingerprints of ``fps`` (fp, distinct) which differ
    in ``distance`` bits or fewer, directly or through a third: the components are exact.

    Multi-index hashing: each fingerprint enters a table once per segment, and probes it
    with the small Hamming ball around its segment; matches are verified on all 64 bits
    inside the join. A group of fingerprints that agree on all segments but one is linked
    as a star to its least member first, and two spokes of one star are not paired again,
    so that a large group of near-copies costs links in proportion to its size.
    Raises if the radii of ``segments`` cannot find every link.
    """
    if sum(r + 1 for _, _, r in segments) < distance + 1:
        raise ValueError("the radii of the segments are too small for the distance")
    if sum(((1 << w) - 1) << low for low, w, _ in segments) != (1 << 64) - 1:
        raise ValueError("the segments do not cover 64 bits once")
    stars = materialize(_stars(fps, segments, distance), "stars")
    hubs = stars.groupBy("fp").pivot("scheme", list(range(len(segments)))).agg(F.min("hub"))
    names = [f"hub{i}" for i in range(len(segments))]
    hubs = hubs.toDF("fp", *names)
    known = fps.select("fp").join(hubs, "fp", "left").select("fp", *[F.coalesce(n, "fp").alias(n) for n in names])
    entry, probe = [], []
    for i, (low, width, radius) in enumerate(segments):
        at = _segment("fp", low, width)
        entry.append(F.struct(F.lit(i).alias("segment"), at.alias("value")))
        balls = F.array(*[F.lit(m).cast("long") for m in _balls(width, radius)])
        probe.append(F.transform(balls, _probe(i, at)))
    into = known.select(F.col("fp").alias("v"), *[F.col(n).alias(f"v_{n}") for n in names], F.explode(F.array(*entry)).alias("k"))
    into = into.select("*", "k.segment", "k.value").drop("k")
    ask = known.select(F.col("fp").alias("u"), *[F.col(n).alias(f"u_{n}") for n in names], F.explode(F.concat(*probe)).alias("k"))
    ask = ask.select("*", "k.segment", "k.value").drop("k")
    apart = F.lit(True)
    for n in names:
        apart = apart & (F.col(f"u_{n}") != F.col(f"v_{n}"))
    on = (ask.segment == into.segment) & (ask.value == into.value) & (ask.u < into.v) & (_differ("u", "v") <= distance) & apart
    pairs = ask.join(into, on).select("u", "v")
    return pairs.unionByName(stars.select(F.col("fp").alias("u"), F.col("hub").alias("v")).where("u <> v"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE,
    seed: int = 42,
    distance: int | None = None,
    segments: Sequence[tuple[int, int, int]] = SEGMENTS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per row of ``docs``: (id, ``fp``, ``component_id``).

    Two documents are linked if the Jaccard similarity of their sets of shingles is at
    least ``similarity`` (then ``fp`` is a hash of the set) or, if ``distance`` is given,
    if their SimHash fingerprints differ in so many bits or fewer; ``component_id`` is the
    smallest id that can be reached over links. Null and empty texts have the same ``fp``
    (as SimHash 0) and are linked. A row with a null id keeps its
    row and joins its component, but null is no component's id unless all its ids are
    null. Repeated rows each give a row. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    if distance is None:
        text = F.col(text_col).cast("string")
        plan = plan_tables(docs.count(), similarity)
        rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
        schema = f"id {rows.schema['id'].dataType.simpleString()}, hash long, fp long, n int, found array<long>, odd array<long>"
        marked = materialize(rows.mapInArrow(_shingle_rows(words, seed, plan.n_words), schema), "fingerprints")
        least = marked.groupBy("fp").agg(F.min("id").alias("least"))
        roots = connected_components(shingle_links(rows.select("hash", "text"), marked, plan, words, seed, similarity))
        marked = marked.select("id", "fp")
    else:
        marked = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), words, seed).alias("fp")), "fps")
        least = marked.groupBy("fp").agg(F.min("id").alias("least"))
        roots = connected_components(fingerprint_links(least.select("fp"), distance, segments))
    placed = least.join(roots.hint("merge"), least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "roots")
    release(docs.sparkSession)
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(component.hint("merge"), "root").select("fp", "component_id")
    return marked.join(labels.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that with the smallest id.

    Of rows that share that id the one with the least text hash stays. A component whose
    ids are all null keeps all its rows, as none can be told apart by its id.
    """
    kept = materialize(near_duplicates(docs, id_col, text_col, **how).where(F.col("component_id").eqNullSafe(F.col(id_col))).select(id_col), "kept")
    out = docs.join(kept.distinct(), docs[id_col].eqNullSafe(kept[id_col]), "left_semi")
    twice = kept.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if twice.isEmpty():
        return out
    once = out.join(twice, id_col, "left_anti").select(*docs.columns)
    many = out.join(twice, id_col, "left_semi").select(*docs.columns)
    best = many.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text_col)).alias("_row"))
    return once.unionByName(best.select("_row.*"))
