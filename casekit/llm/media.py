"""Copies among images by local descriptors: cropped, rotated or edited images are found."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bitmap_bits, bound_batches, discard, drop_worker_caches, likely, materialize, release
from .components import connected_components, near_labels

#: Side of the cells of a pyramid level that keep their strongest corner each; pyramid
#: levels, and the step between them.
CELL, LEVELS, STEP = 20, 6, 1.155
#: Radius of a corner's patch; 64-bit words of a descriptor.
RADIUS, WORDS = 13, 4
BITS = 64 * WORDS
#: Fields of each word, one for a hash table each, and keys that a pair of images must share
#: to be compared.
FIELDS, VOTES = 3, 2
#: Bits of a field.
KEY_BITS = 32
#: Bits in which matching descriptors may differ, pixels by which a consensus may miss, and
#: corners that must agree on one similarity transform.
DISTANCE, SLACK, AGREE = 44, 4.0, 4
#: Times that each bucket is linked to one of its images before it is joined with itself.
STAR_ROUNDS = 2


# Decoding ---------------------------------------------------------------------------------


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values (0-255, float32) of a binary PGM or PPM, or of an 8-bit PNG that is not
    interlaced; None for anything else, truncated data and null."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            return _decode_pnm(data)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    pixels = pixels.astype(np.float32)
    return pixels[..., 0] if pixels.shape[2] < 3 else pixels[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)


def _decode_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    if most != 255:
        raise ValueError("8 bits only")
    kinds = 1 if data[:2] == b"P5" else 3
    return _grey(np.frombuffer(data, np.uint8, width * height * kinds, at + 1).reshape(height, width, kinds))


def _decode_png(data: bytes) -> np.ndarray:
    at, body, head, palette = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, laced = head
    kinds = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or laced:
        raise ValueError("8 bits, not interlaced, only")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * kinds + 1)
    out = np.zeros((height, width * kinds), np.uint8)
    above = np.zeros(width * kinds, np.int64)
    for y in range(height):
        way, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if way == 2:
            line = (line + above) & 255
        elif way in (1, 3, 4):
            for x in range(len(line)):
                a = line[x - kinds] if x >= kinds else 0
                b, c = above[x], above[x - kinds] if x >= kinds else 0
                if way == 1:
                    add = a
                elif way == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    add = a if da <= db and da <= dc else b if db <= dc else c
                line[x] = (line[x] + add) & 255
        out[y] = above = line
    pixels = out.reshape(height, width, kinds)
    return _grey(palette[pixels[..., 0]] if colour == 3 else pixels)


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % grey.shape[::-1] + np.clip(np.round(grey), 0, 255).astype(np.uint8).tobytes()


# Features ---------------------------------------------------------------------------------


def _box(image: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1; borders are repeated."""
    wide = np.pad(image, r + 1, mode="edge")[:-1, :-1].cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (wide[n:, n:] - wide[:-n, n:] - wide[n:, :-n] + wide[:-n, :-n]) / (n * n)


def _resize(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear reduction by ``scale``."""
    h, w = (max(1, int(n / scale)) for n in image.shape)
    y, x = np.minimum(np.arange(h) * scale, image.shape[0] - 1), np.minimum(np.arange(w) * scale, image.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return image[np.ix_(y0, x0)] * (1 - fy) * (1 - fx) + image[np.ix_(y1, x0)] * fy * (1 - fx) + image[np.ix_(y0, x1)] * (1 - fy) * fx + image[np.ix_(y1, x1)] * fy * fx


_YX = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1), indexing="ij"), -1)
_DISC = np.hypot(*np.moveaxis(_YX, -1, 0)) <= RADIUS
_OFFSETS = _YX[_DISC]


def _described(smooth: np.ndarray, y: np.ndarray, x: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The angle of the patch around each (y, x), and the outcomes of its turned tests."""
    patch = smooth[y[:, None] + _OFFSETS[:, 0], x[:, None] + _OFFSETS[:, 1]]
    patch = patch - patch.mean(1, keepdims=True)
    angle = np.arctan2(patch @ _OFFSETS[:, 0], patch @ _OFFSETS[:, 1])
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    px = np.rint(pairs[..., 0] * cos - pairs[..., 1] * sin).astype(int) + x[:, None, None]
    py = np.rint(pairs[..., 0] * sin + pairs[..., 1] * cos).astype(int) + y[:, None, None]
    values = smooth[py, px]
    return angle, values[..., 0] < values[..., 1]


@lru_cache(1)
def _tests() -> np.ndarray:
    """Pairs of points (bits, 2, 2): of many drawn at random those whose outcomes on patches
    of smoothed noise are even and little correlated, by a rule: the most even first, each
    next one if its correlation with all before it is below a bound that is raised until
    there are enough. Correlated tests would make unlike patches agree by chance."""
    rng = np.random.default_rng(20)
    points = rng.uniform(-RADIUS, RADIUS, (6000, 2, 2))
    inside = (np.hypot(*points[:, 0].T) < RADIUS - 1) & (np.hypot(*points[:, 1].T) < RADIUS - 1)
    points = points[inside & (np.hypot(*(points[:, 0] - points[:, 1]).T) > 4)][: 7 * BITS]
    outcomes = []
    for _ in range(40):
        fine, coarse = _box(rng.normal(0, 1, (120, 120)), 1), _box(_box(rng.normal(0, 1, (120, 120)), 1), 2)
        smooth = _box(_box(fine / fine.std() + coarse / coarse.std(), 1), 1)
        y, x = rng.integers(RADIUS + 1, 120 - RADIUS - 1, (2, 30))
        outcomes.append(_described(smooth, y, x, points)[1])
    bits = np.concatenate(outcomes).astype(np.float32)
    mean = bits.mean(0)
    z = (bits - mean) / (bits.std(0) + 1e-6)
    alike = np.abs(z.T @ z) / len(bits)
    order = np.argsort(np.abs(mean - 0.5), kind="stable")
    bound = 0.1
    while True:
        chosen: list[int] = []
        for i in order.tolist():
            if not chosen or alike[i, chosen].max() < bound:
                chosen.append(i)
        if len(chosen) >= BITS:
            return points[chosen[:BITS]]
        bound += 0.05


def _corners(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of the strongest local maximum in each cell of a level."""
    wide = np.pad(score, 3, constant_values=-np.inf)
    top = score
    for axis in (0, 1):
        some = wide if axis == 0 else np.pad(top, ((0, 0), (3, 3)), constant_values=-np.inf)
        size = score.shape[axis]
        top = np.max([some[d : d + size, 3:-3] if axis == 0 else some[:, d : d + size] for d in range(7)], axis=0)
    inner = np.zeros(score.shape, bool)
    inner[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1] = True
    y, x = np.nonzero(inner & (score >= top) & (score > 1.0))
    cell = (y // CELL) * (score.shape[1] // CELL + 1) + x // CELL
    order = np.lexsort((x, y, -score[y, x], cell))
    first = order[np.unique(cell[order], return_index=True)[1]]
    return y[first], x[first]


def features(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, angle, scale) and descriptors (``WORDS`` int64) of an image's corners.

    Corners are local maxima of Harris' measure on each level of a pyramid, the strongest
    in each cell of a grid, so that their number grows with the area and every part of the
    image has some. A corner's angle is that of its patch's centre of mass, and the tests of
    its descriptor, each of which compares two smoothed grey values, are turned by it: a
    turned, brightened or cropped image has nearly the same descriptors.
    """
    where, codes = [np.zeros((0, 4), np.float32)], [np.zeros((0, WORDS), np.int64)]
    for level in range(LEVELS):
        scale = STEP**level
        now = image if level == 0 else _resize(_box(image, 1), scale)
        if min(now.shape) < 2 * RADIUS + 3:
            break
        smooth = _box(now, 1)
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        y, x = _corners(a * b - c * c - 0.05 * (a + b) ** 2)
        if not len(y):
            continue
        smooth = _box(smooth, 1)
        for at in range(0, len(y), 256):
            v, h = y[at : at + 256], x[at : at + 256]
            angle, bits = _described(smooth, v, h, _tests())
            codes.append(np.packbits(bits, axis=1, bitorder="little").view(np.int64))
            where.append(np.stack((h * scale, v * scale, angle, np.full(len(v), scale)), 1).astype(np.float32))
    return np.concatenate(where), np.concatenate(codes)


def consensus(pairs: np.ndarray, slack: float = SLACK) -> int:
    """Most corners of both images that agree with one similarity transform, of those that
    each row (x, y, angle, scale of a; the same of b) proposes by its own two corners."""
    xa, ya, ta, sa, xb, yb, tb, sb = pairs.T
    turn, grow = tb - ta, sb / sa
    cos, sin = grow * np.cos(turn), grow * np.sin(turn)
    best = 0
    for at in range(0, len(pairs), 64):
        k = slice(at, at + 64)
        dx, dy = xa[None] - xa[k, None], ya[None] - ya[k, None]
        off = np.hypot(xb[k, None] + cos[k, None] * dx - sin[k, None] * dy - xb[None], yb[k, None] + sin[k, None] * dx + cos[k, None] * dy - yb[None])
        for ok in off <= slack:
            best = max(best, min(len(set(zip(xa[ok].tolist(), ya[ok].tolist(), strict=True))), len(set(zip(xb[ok].tolist(), yb[ok].tolist(), strict=True)))))
    return best


# Tables -----------------------------------------------------------------------------------

_FEATURES = "id long, places array<float>, codes array<long>"


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per image that has corners: their places (four values each) and codes."""
    drop_worker_caches()
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            some = batch.slice(at, 100)
            ids, where, codes = [], [], []
            for key, data in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                image = decode(data.as_py())
                w, c = features(image) if image is not None else (np.zeros((0, 4), np.float32), None)
                if len(w):
                    ids.append(key)
                    where.append(w.ravel())
                    codes.append(c.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(where, np.float32), _lists(codes, np.int64)], names=["id", "places", "codes"])


def compare(places_u: np.ndarray, codes_u: np.ndarray, places_v: np.ndarray, codes_v: np.ndarray, distance: int = DISTANCE) -> int:
    """Corners of two images (as of ``features``) whose descriptors match and that agree on
    one similarity transform."""
    rows = []
    for at in range(0, len(codes_u), 256):
        apart = np.bitwise_count(codes_u[at : at + 256, None].view(np.uint64) ^ codes_v[None].view(np.uint64)).sum(2)
        i, j = np.nonzero(apart <= distance)
        rows.append(np.concatenate([places_u[at + i], places_v[j]], 1))
    pairs = np.concatenate(rows).astype(np.float64) if rows else np.zeros((0, 8))
    return consensus(pairs) if len(pairs) else 0


def _compare_rows(distance: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            us, vs, ns = [], [], []
            for row in range(batch.num_rows):
                u, v = batch.column("u")[row].as_py(), batch.column("v")[row].as_py()
                parts = [batch.column(c)[row].values.to_numpy().reshape(-1, n) for c, n in (("places_u", 4), ("codes_u", WORDS), ("places_v", 4), ("codes_v", WORDS))]
                n = compare(*parts, distance)
                if n >= agree:
                    us.append(u)
                    vs.append(v)
                    ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int32())], names=["u", "v", "agree"])

    return run


def key_bits(n_images: int = 0) -> int:
    """Bits of a table's key: the same for any number of images, as a pair that meets in a
    small table must meet in a large one, too."""
    return KEY_BITS


def _keys(bits: int):
    """Array of all keys of an image's ``codes``: fields of each word, marked by their table."""

    def of(x, i):
        return F.array(*_fields(x, (i % WORDS).cast("long"), bits))

    return F.array_distinct(F.flatten(F.transform("codes", of)))


def _fields(word, table, bits: int) -> list:
    cut = lambda at: F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << bits) - 1))
    return [F.shiftleft(table * FIELDS + k, bits).bitwiseOR(cut((64 - bits) * k // (FIELDS - 1))) for k in range(FIELDS)]


#: Columns of a descriptor's words.
_CODE = [f"c{w}" for w in range(WORDS)]


def _corner_keys(bits: int):
    """Array of (key, descriptor) of all corners of an image's ``codes``."""

    def of(j):
        code = [F.get("codes", j * WORDS + w) for w in range(WORDS)]
        keys = [key for w in range(WORDS) for key in _fields(code[w], F.lit(w).cast("long"), bits)]
        return F.array(*[F.struct(key.alias("key"), *[x.alias(c) for x, c in zip(code, _CODE, strict=True)]) for key in keys])

    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size("codes") / WORDS).cast("int") - 1), of))


def image_copies(media: DataFrame, id_col: str = "id", image_col: str = "image", distance: int = DISTANCE, agree: int = AGREE, votes: int = VOTES) -> tuple[DataFrame, DataFrame]:
    """(classes, links). ``classes`` has one row per row of ``media``: (id, class_id,
    n_links); ``links`` has pairs (u, v, agree) of class representatives that were verified.

    Images with the same bytes are one representative (that with the least id, which must
    be an integer). Its corners' descriptors enter ``FIELDS * WORDS`` hash tables, by a field
    of ``KEY_BITS`` of their bits each. Corners that share a key meet if their descriptors
    are within ``distance`` on all bits: of keys shared by chance, whose number grows with
    the square of the table, hardly any remain. Two images that meet ``votes`` times or more are
    compared: all their descriptors within ``distance`` on all bits, and a geometric
    consensus of ``agree`` corners. A corner of a copy keeps a key with a chance that falls
    with the bits that its edit changes; as two keys of hundreds suffice, copies are found
    with the recall that the README states by kind of edit. First every image meets one of
    each bucket's images only, that of the least and in turn of the greatest component, in
    up to ``STAR_ROUNDS`` rounds, and is compared with that of them which it meets most
    often; all others are left to what follows: where a bucket holds several components, the members
    of all but the least one meet the whole bucket. So a large group of copies costs pairs
    in proportion to its size, and nothing is lost to a cap. Images without corners, that
    cannot be decoded, or null, link only to the same bytes; null images are each their own
    class. A null id has a class of its own bytes, too, but is no class's id unless all its
    ids are null. ``n_links`` counts the verified links of the row's representative that
    were made to connect its component: images that are connected already are not compared,
    so it depends on which image was a hub.
    """
    bound_batches(media.sparkSession, 500)
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image"))
    rows = rows.withColumn("bytes", F.sha2("image", 256)).withColumn("mark", F.xxhash64("id", "bytes"))
    named = materialize(rows.select("id", "bytes", "mark"), "images")
    reps = named.where("bytes is not null").groupBy("bytes").agg(F.min("id").alias("rep"))
    # Images stay where they are, but for those with copies of their bytes.
    chosen = named.join(reps, "bytes").where(F.col("id") == F.col("rep")).groupBy("mark").agg(F.count("*").alias("n"))
    odd = named.where("bytes is not null").groupBy("mark").agg(F.count("*").alias("n")).join(chosen.where("n = 1").select("mark"), "mark", "left_anti").select("mark")
    odd = materialize(odd, "odd")
    images = rows.where("id is not null and bytes is not null")
    twice = likely(images, "mark", odd).select("id", "image", "mark")
    once = twice.join(chosen.select("mark"), "mark").dropDuplicates(["mark"])
    images = likely(images, "mark", odd, there=False).select("id", "image").unionByName(once.select("id", "image"))
    found = materialize(images.mapInArrow(_feature_rows, _FEATURES), "features")
    n = named.count()
    # So few images a task that counting their keys needs no spill.
    dealt = found.select("id", "codes").repartition(max(int(media.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)), "id")
    thin = dealt.select("id", F.explode(_keys(KEY_BITS)).alias("key"))
    met_by = thin.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    met_by = materialize(met_by, "keys")
    thick = dealt.select("id", F.explode(_corner_keys(KEY_BITS)).alias("x")).select("id", "x.*")
    entries = materialize(likely(thick, "key", met_by, bitmap_bits(met_by.count())).join(met_by, "key").distinct(), "entries")
    links = roots = None
    release(media.sparkSession)

    def placed() -> DataFrame:
        if roots is None:
            return entries.withColumn("root", F.col("id"))
        return entries.join(roots, entries["id"] == roots["node"], "left").select("id", "key", *_CODE, F.coalesce("root", "id").alias("root"))

    def ends(rows: DataFrame, end: str, *more: str) -> DataFrame:
        return rows.select("key", F.col("id").alias(end), F.col("root").alias(f"root_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in (*_CODE, *more)])

    # Of a pair that meets at a key, whether the two corners match.
    apart = [F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in _CODE]
    match = (sum(apart[1:], apart[0]) <= distance) & (F.col("root_u") != F.col("root_v"))

    def often(met: DataFrame, by: list[str]) -> DataFrame:
        return met.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= votes)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v, agree) that reach a consensus."""
        pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        for end in "uv":
            side = found.select(F.col("id").alias(end), F.col("places").alias(f"places_{end}"), F.col("codes").alias(f"codes_{end}"))
            pairs = pairs.join(side, end)
        return materialize(pairs.mapInArrow(_compare_rows(distance, agree), "u long, v long, agree int"), "verified")

    for turn in range(STAR_ROUNDS):
        now, one = placed(), F.struct("root", "id", *_CODE)
        hub = now.groupBy("key").agg((F.max(one) if turn % 2 else F.min(one)).alias("h"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        met = ends(now, "v").join(ends(hub.select("key", "h.*"), "u"), "key").where(match)
        best = often(met, ["v", "u"]).groupBy("v").agg(F.max(F.struct("n", (-F.col("u")).alias("of"))).alias("x"))
        more = verified(best.select("v", (-F.col("x.of")).alias("u")))
        links = more if links is None else links.unionByName(more)
        roots = materialize(near_labels(links), "star_roots")
        release(media.sparkSession)
        if more.isEmpty():
            break
    now = placed()
    several = now.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key", "least")
    now = materialize(now.join(several, "key"), "open")
    a, b = (ends(now, end, "least") for end in "uv")
    # Of two that are both outside the least component, the smaller id asks.
    asks = (F.col("root_v") == F.col("least_v")) | (F.col("u") < F.col("v"))
    met = a.where("root_u <> least_u").join(b, "key").where(match & asks)
    met = often(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"])
    links = materialize(links.unionByName(verified(met)).groupBy("u", "v").agg(F.max("agree").alias("agree")), "links")
    classes = connected_components(links)
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    labels = reps.join(classes, reps["rep"] == classes["node"], "left").join(degree, "rep", "left")
    labels = labels.select("bytes", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = named.join(labels, "bytes", "left")
    alone = F.col("bytes").isNull()
    out = out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    for done in (found, met_by, entries, now):
        discard(done)
    return out, links


# A media table from vectors -----------------------------------------------------------------

_FIELDS: dict[tuple[int, int], np.ndarray] = {}


def _patterns(n: int, side: int) -> np.ndarray:
    """``n`` fixed fields of smoothed noise: fine and, every other one, coarse."""
    if (n, side) not in _FIELDS:
        noise = np.random.default_rng(n).normal(0, 1, (n, side, side))
        fields = [_box(x, 1) if k % 2 else _box(_box(x, 1), 2) for k, x in enumerate(noise)]
        _FIELDS[n, side] = np.stack([x / x.std() for x in fields]).reshape(n, -1)
    return _FIELDS[n, side]


def render(vector: list[float] | None, side: int = 96) -> np.ndarray | None:
    """A grey image of a vector: the sum of fixed fields of smoothed noise, one for each
    place, weighted by its values. None for null, empty and constant vectors."""
    values = np.array([x for x in (() if vector is None else vector) if x is not None and np.isfinite(x)])
    if len(values) == 0 or values.min() == values.max():
        return None
    field = (values @ _patterns(len(values), side)).reshape(side, side)
    return np.clip(128 + 45 * (field - field.mean()) / field.std(), 0, 255)


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """``image`` turned about its centre, bilinear; what comes from outside repeats its border."""
    t = np.deg2rad(degrees)
    h, w = image.shape
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    y, x = np.cos(t) * y - np.sin(t) * x + (h - 1) / 2, np.sin(t) * y + np.cos(t) * x + (w - 1) / 2
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 2), np.clip(np.floor(x).astype(int), 0, w - 2)
    fy, fx = np.clip(y - y0, 0, 1), np.clip(x - x0, 0, 1)
    return image[y0, x0] * (1 - fy) * (1 - fx) + image[y0 + 1, x0] * fy * (1 - fx) + image[y0, x0 + 1] * (1 - fy) * fx + image[y0 + 1, x0 + 1] * fy * fx


#: Kinds of edits.
EDITS = ("crop", "three quarters", "quarter turn", "turn", "smaller", "noise", "blur")


def edit(image: np.ndarray, way: int) -> np.ndarray:
    """An edited copy, by ``EDITS`` in turn: cropped by under a tenth and darkened, cropped to
    three quarters of its sides, turned by a quarter, turned by 20 degrees, reduced to three
    quarters, with noise, blurred."""
    h, w = image.shape
    kind = EDITS[way % len(EDITS)]
    cut = image[h // 12 + way % 5 : h - way % 3, w // 16 + way % 4 : w - w // 20] * 0.9 + 12
    if kind == "crop":
        return cut
    if kind == "three quarters":
        return image[h // 8 : h // 8 + h * 3 // 4, w // 8 : w // 8 + w * 3 // 4]
    if kind == "quarter turn":
        return np.ascontiguousarray(np.rot90(cut))
    if kind == "turn":
        return turned(image, 20)
    if kind == "smaller":
        return _resize(image, 4 / 3)
    return image + np.random.default_rng(way).normal(0, 6, image.shape) if kind == "noise" else _box(image, 1)


def _rendered(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids, images = [], []
                for key, vector in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    image = render(vector)
                    ids.append(key)
                    images.append(None if image is None else encode_pgm(image))
                    if image is not None and key is not None and key % every == 0:
                        ids.append(-key - 1)
                        images.append(encode_pgm(edit(image, key // every)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["id", "image"])

    return run


def media_of_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20) -> DataFrame:
    """(id, image): every vector rendered as a PGM file, and for ids divisible by ``every``
    an edited copy under the id ``-id - 1``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(_rendered(every), "id long, image binary")
