import struct
import zlib

import numpy as np
import pytest

from casekit.llm import media
from casekit.llm._common import bitmap_bits


def png(image, colour=0, way=0):
    """A PNG of grey (0) or RGB (2) values, each line with filter ``way``."""
    pixels = np.repeat(image[..., None], 3, 2) if colour == 2 else image[..., None]
    h, w, k = pixels.shape
    flat = pixels.reshape(h, w * k).astype(np.int64)
    lines = []
    for y in range(h):
        above = flat[y - 1] if y else np.zeros(w * k, np.int64)
        a = np.concatenate((np.zeros(k, np.int64), flat[y][:-k]))
        c = np.concatenate((np.zeros(k, np.int64), above[:-k]))
        p = a + above - c
        d = np.stack([abs(p - a), abs(p - above), abs(p - c)])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], above, c))
        guess = (0, a, above, (a + above) // 2, paeth)[way]
        lines.append(bytes([way]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes())
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


def image(seed, side=96):
    return np.round(media.render(np.random.default_rng(seed).normal(size=64).tolist(), side))


def test_decoding():
    x = image(1)
    assert np.array_equal(media.decode(media.encode_pgm(x)), x)
    for colour in (0, 2):
        for way in range(5):
            assert np.allclose(media.decode(png(x, colour, way)), x, atol=0.01)
    assert np.array_equal(media.decode(b"P5 # note\n2 1 255\n\x01\x02"), [[1, 2]])
    for bad in (None, b"", b"P5", b"P5\n9 9\n255\nxx", b"GIF89a", b"\x89PNG\r\n\x1a\n", png(x)[:60]):
        assert media.decode(bad) is None


def test_consensus_needs_one_transform():
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 90, (20, 2))
    t = 0.7
    b = a @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) * 1.5 + 7
    rows = np.column_stack([a, np.zeros(20), np.ones(20), b, np.full(20, t), np.full(20, 1.5)])
    assert media.consensus(rows) == 20
    rows[:, 4:6] = rng.uniform(0, 90, (20, 2))
    assert media.consensus(rows) < 6


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i in range(12):
        x = image(i)
        rows.append((i, media.encode_pgm(x)))
        if i < 8:
            rows.append((100 + i, media.encode_pgm(media.edit(x, i))))
    rows += [(50, media.encode_pgm(image(0))), (51, png(image(1))), (60, None), (61, None), (62, b"junk"), (63, b"junk"), (None, media.encode_pgm(image(2))), (64, media.encode_pgm(np.full((96, 96), 9.0))), (65, media.encode_pgm(image(3, 16)))]
    return spark.createDataFrame([(d, i, 0) for i, d in rows], "image binary, id long, class_id int")


def test_copies(spark, table):
    classes, links = media.image_copies(table)
    got = {r.id: r.class_id for r in classes.collect()}
    want = {i: i for i in range(12)} | {100 + i: i for i in range(8)} | {50: 0, 51: 1, 60: 60, 61: 61, 62: 62, 63: 62, None: 2, 64: 64, 65: 65}
    assert got == want and classes.count() == table.count()
    pairs = {(r.u, r.v) for r in links.collect()}
    assert {(i, 100 + i) for i in range(8)} <= pairs and all(r.agree >= media.AGREE for r in links.collect())
    empty = media.image_copies(table.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def matched(a, b, bits):
    """(corners that agree, keys shared) of two images."""
    (fa, ca), (fb, cb) = media.features(a), media.features(b)
    keys = [{(w, at, int(x)) for w in range(media.WORDS) for at in (0, (64 - bits) // 2, 64 - bits) for x in (c[:, w].view(np.uint64) >> np.uint64(at)) & np.uint64((1 << bits) - 1)} for c in map(np.ascontiguousarray, (ca, cb))]
    return (media.compare(fa, ca, fb, cb) if len(fa) and len(fb) else 0), len(keys[0] & keys[1])


def test_recall_by_kind_of_edit():
    n, bits = 30, media.key_bits(1 << 16)
    for k, kind in enumerate(media.EDITS):
        rows = [matched(x, np.round(np.clip(media.edit(x, 7 * i + k), 0, 255)), bits) for i, x in enumerate(map(image, range(n)))]
        found = np.mean([agree >= media.AGREE and shared >= media.VOTES for agree, shared in rows])
        assert found >= 0.9, (kind, found)
    others = [matched(image(i), image(i + 1), bits) for i in range(n)]
    assert max(agree for agree, _ in others) < media.AGREE and sum(shared >= media.VOTES for _, shared in others) <= 1


def test_small_crops_of_large_images():
    for i in range(3):
        x = np.round(media.render(np.random.default_rng(i).normal(size=16).tolist(), 320))
        agree, shared = matched(x, np.ascontiguousarray(x[100:228, 150:278]), 32)
        assert agree >= media.AGREE and shared >= media.VOTES
    fa, fb = (len(media.features(image(0, side))[0]) for side in (96, 192))
    assert fb > 3 * fa


def test_many_equal_corners(spark):
    tile = np.kron(np.indices((16, 16)).sum(0) % 2, np.ones((12, 12))) * 200.0
    rows = [(i, media.encode_pgm(tile[i:])) for i in range(4)]
    got = media.image_copies(spark.createDataFrame(rows, "id long, image binary"))[0]
    assert {r.class_id for r in got.collect()} == {0}


def test_media_of_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(41)] + [(60, None), (80, []), (100, [1.0] * 64), (None, rng.normal(size=64).tolist())]
    out = media.media_of_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(r.id for r in out if r.id is not None and r.id < 0) == [-41, -21, -1] and len(out) == 45 + 3
    assert all((r.image is None) == (r.id in (60, 80, 100)) for r in out)


def test_keys_do_not_depend_on_the_number_of_images():
    assert {media.key_bits(n) for n in (0, 1, 20, 1 << 16, 1 << 19, 1 << 40)} == {media.KEY_BITS}


def test_groups_and_chance_keys_cost_few_rows(spark, monkeypatch):
    """A group costs a comparison an image; keys that unlike corners share cost none."""
    counts, real = [], media.materialize

    def counted(df, tag):
        out = real(df, tag)
        counts.append((tag, out.count()))
        return out

    monkeypatch.setattr(media, "materialize", counted)
    rng, base = np.random.default_rng(2), image(7)
    rows = [(i, media.encode_pgm(np.clip(base + rng.normal(0, 3 + i / 4, base.shape), 0, 255))) for i in range(40)]
    classes, links = media.image_copies(spark.createDataFrame(rows, "id long, image binary"))
    assert {r.class_id for r in classes.collect()} == {0} and classes.count() == 40
    assert sum(n for tag, n in counts if tag == "pairs") <= 2 * 40 and links.count() <= 2 * 40
    monkeypatch.setattr(media, "KEY_BITS", 4)  # every two images share keys
    counts.clear()
    rows = [(i, media.encode_pgm(image(i))) for i in range(12)]
    classes, _ = media.image_copies(spark.createDataFrame(rows, "id long, image binary"))
    assert [r.class_id for r in classes.orderBy("id").collect()] == list(range(12))
    assert sum(n for tag, n in counts if tag == "pairs") <= 12 and dict(counts)["keys"] > 12


def test_the_bitmap_of_keys_grows_with_them(spark, monkeypatch):
    """At a fixed size ever more keys pass it by chance as their number grows."""
    used, real = [], media.likely
    monkeypatch.setattr(media, "likely", lambda rows, key, need, *bits, **how: used.append(bits) or real(rows, key, need, *bits, **how))
    monkeypatch.setattr(media, "bitmap_bits", lambda n: used.append(n) or 18)
    rows = [(i, media.encode_pgm(media.edit(image(0), i) if i else image(0))) for i in range(2)]
    assert {r.class_id for r in media.image_copies(spark.createDataFrame(rows, "id long, image binary"))[0].collect()} == {0}
    assert (18,) in used and any(isinstance(x, int) and x > 10 for x in used)


def test_a_bitmap_has_few_bits_set():
    assert [bitmap_bits(n) for n in (0, 1, 1 << 19, (1 << 19) + 1, 1 << 21, 1 << 40)] == [25, 25, 25, 26, 27, 27]
