import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casekit.llm import components, simhash
from casekit.llm._common import likely
from casekit.llm.components import connected_components, near_labels


def slow_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


TEXTS = [None, "", " \t\n", "one", "One two THREE", "a b c d e f g", "ÀB c d é", "x " * 3000, "a b\x0bc\x0cd\re"]


def test_fingerprints(spark):
    for t in TEXTS:
        assert simhash.fingerprint(t) % (1 << 64) == slow_fingerprint(t)
    assert simhash.fingerprint("ONE two") == simhash.fingerprint("one TWO") != simhash.fingerprint("ÀB") != simhash.fingerprint("àb")
    df = spark.createDataFrame([("a b c d e",)], "t string")
    mine = df.select(simhash.fingerprint_hex(simhash.fingerprint_column("t")), F.lower(F.hex(F.xxhash64(F.lit("x"))))).first()
    assert int(mine[0], 16) == slow_fingerprint("a b c d e") and len(mine[0]) == 16
    assert mine[1] == "%016x" % xxhash.xxh64_intdigest("x", 42)


def components_by_hand(values, distance=4):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_links_find_every_component(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 62), 1 << 62, 25)
    values = set(centres.tolist())
    for c in centres:  # clouds and chains around them
        now = int(c)
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                now ^= 1 << int(b)
            now = (now + (1 << 63)) % (1 << 64) - (1 << 63)
            values.add(now)
    base = int(centres[0])
    values |= {((base ^ 1 << i) + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(64)}
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df)).collect()}
    want = components_by_hand(values)
    assert [found.get(v, v) for v in values] == [values[k] for k in want]
    with pytest.raises(ValueError, match="radii"):
        simhash.fingerprint_links(df, 6)
    with pytest.raises(ValueError, match="cover"):
        simhash.fingerprint_links(df, 1, ((0, 21, 1), (21, 21, 0), (42, 21, 0)))


def test_a_tight_group_costs_few_links(spark):
    values = [sum(1 << b for b in range(11) if k >> b & 1) for k in range(2048) if bin(k).count("1") <= 2]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    assert simhash.fingerprint_links(df).count() <= 4 * len(values)


def test_documents_with_odd_columns(spark):
    near = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 12
    rows = [(5, near, 1), (3, near + "again", 2), (9, None, 3), (7, "", 4), (None, near, 5), (3, near + "again", 6), (11, "quite another text than all of these", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", F.lit("x"))
    got = simhash.near_duplicates(df)
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (9, 7), (11, 11)]
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 7, 11]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingle_hashes_tell_shingles_apart():
    rng = np.random.default_rng(6)
    text = " ".join(f"W{k}" for k in rng.integers(0, 9, 400))
    assert len(simhash.shingles(text)) == len(slow_shingles(text))
    assert simhash.shingles(text.swapcase()).tolist() == simhash.shingles(text).tolist() != simhash.shingles(text, seed=1).tolist()
    assert len(simhash.shingles("one two")) == 1 and len(simhash.shingles(None)) == len(simhash.shingles(" \n")) == 0


def test_blocks_do_not_change_shingle_hashes(monkeypatch):
    text = " ".join(f"word{k}" for k in range(3000)) + " " + "x" * 5000 + " end of it all"
    whole = simhash.shingles(text)
    monkeypatch.setattr(simhash, "_BLOCK", 100)
    assert simhash.shingles(text).tolist() == whole.tolist() and len(whole) == 3001


def test_long_fingerprints():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 300, 20_000):
        values = rng.integers(0, 1 << 63, n, np.uint64)
        mixed = values[:, None] * simhash._WORDS[:2]
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        want = [sum(1 << b for b in range(64) if 2 * int((mixed[:, w] >> np.uint64(b) & np.uint64(1)).sum()) > n) for w in range(2)]
        assert simhash.long_fingerprint(values, 2).view(np.uint64).tolist() == want
    a = rng.integers(0, 1 << 63, 900, np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 100, np.uint64)))  # 0.8
    plan = simhash.plan_tables(10**6)
    apart = np.bitwise_count((simhash.long_fingerprint(a, 40) ^ simhash.long_fingerprint(b, 40)).view(np.uint64)).sum()
    assert abs(apart / 2560 - plan.differ) < 0.03
    assert plan.width == 20 and plan.tables >= 33 and simhash.plan_tables(10**10).width == 31 and simhash.plan_tables(0).width == 10


def test_large_groups_of_near_copies(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(2):
        words = [f"g{g}w{k}" for k in rng.integers(0, 3000, 200)]
        for _ in range(150):
            copy = list(words)
            copy[int(rng.integers(200))] = f"n{rng.integers(1 << 30)}"
            rows.append(" ".join(copy))
    rows += [" ".join(f"v{k}" for k in rng.integers(0, 9000, 200)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(400)] == [0] * 150 + [150] * 150 + list(range(300, 400))


def slow_shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):
        words = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(40, 300)))]
        texts.append(" ".join(words))
        for edits in rng.integers(1, 9, 3):  # copies at 0.3 to 0.97
            copy = list(words)
            for k in rng.choice(len(words), edits, replace=False):
                copy[k] = "new"
            texts.append(" ".join(copy))
    sets = [slow_shingles(t) for t in texts]
    label = list(range(len(texts)))
    alike = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
    for _ in range(4):
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(alike) > 40
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == set(label)
    far = simhash.near_duplicates(df, words=4, distance=4)  # 4 bits miss most of them
    assert far.select("component_id").distinct().count() > len(set(label)) + 20


def test_a_bitmap_of_keys_does_not_pass_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: pytest.fail("the driver holds the keys"))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("the driver makes the bitmap"))
    rows, need = spark.range(4000).withColumn("k", F.col("id") * 7), spark.range(0, 4000, 4).select((F.col("id") * 7).alias("k"))
    for bits in (18, 24):
        kept = {r.id for r in likely(rows, "k", need, bits).collect()}
        assert set(range(0, 4000, 4)) <= kept and len(kept) < 1100
        assert {r.id for r in likely(rows, "k", need, bits, there=False).collect()} == set(range(4000)) - kept
    assert likely(rows, "k", need.limit(0)).count() == 0


def test_labels_are_written_every_two_hops(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, tag: written.append(tag) or df)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], "u long, v long")
    assert {r.node: r.root for r in near_labels(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert len(written) == 1


def test_odd_sketches_bound_what_sets_do_not_share():
    rng = np.random.default_rng(11)
    for n, new in ((146, 5), (146, 25), (900, 120), (3, 1)):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate((a[new:], rng.integers(0, 1 << 63, new, np.uint64)))
        apart = np.bitwise_count((simhash.odd_sketch(a) ^ simhash.odd_sketch(b)).view(np.uint64)).sum()
        assert 0.6 * 2 * new <= apart <= 2 * new


def test_blocks_find_the_balls_of_radius_one(spark):
    """Segments share a key, and its part's bits allow it, if they differ in one bit at most."""
    for width in (10, 16, 18, 24, 31):
        plan = simhash.Plan(width, 64 // width, 1, 0.15)
        blocks = simhash._blocks(plan)
        assert [low for low, _ in blocks] + [width] == [0] + [low + bits for low, bits in blocks] and max(bits for _, bits in blocks) <= simhash.OPEN
        rows = spark.createDataFrame([(0, 5 << 40)] + [(1 + b, 5 << 40 | 1 << b) for b in range(width)], "id int, key long")
        got = rows.select("id", simhash._opened(plan, [(F.lit(3), 0)])).select("id", "x.*").collect()
        base = {r.key: r.part for r in got if r.id == 0}
        assert len(base) == len(blocks)
        assert all(sum(r.key in base and (r.part ^ base[r.key]).bit_count() == 1 for r in got if r.id == 1 + b) == 1 for b in range(width))


def test_unlike_variants_of_one_text_cost_few_pairs(spark, monkeypatch):
    """Variants that are just not similar enough for each other are no rows; those that are, are found."""
    counts, real = [], simhash.materialize

    def counted(df, tag):
        out = real(df, tag)
        counts.append((tag, out.count()))
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in rng.integers(0, 3000, 150)]
    rows = []
    for i in range(200):
        copy = list(base)
        for k in rng.choice(150, 1 if i % 8 == 0 else 4, replace=False):
            copy[int(k)] = f"n{rng.integers(1 << 30)}"
        rows.append(" ".join(copy))
    sets = [slow_shingles(t) for t in rows]
    alike = {(i, j) for i in range(200) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")).collect()}
    label = list(range(200))
    for _ in range(20):
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    assert [got[i] for i in range(200)] == label and len(set(label)) > 100
    assert sum(n for tag, n in counts if tag == "pairs") < 200 * 199 / 2 / 4
