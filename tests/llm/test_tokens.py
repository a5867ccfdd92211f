import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from casekit.llm import tokens


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.default_vocabulary())


def expected(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_give_the_ids_of_whole_texts(plain):
    rng = random.Random(1)
    parts = ["a", "b ", " ", "  ", "\n", "\n ", " \n", "é", "ß", "\t", "<|endoftext|>", "1", "$$", "\xa0", " ", "x", "日本", "😀", "'s", " don", ""]
    texts = [None, "", " ", "a", " a", "a ", "\n", "a\n b", "<|endoftext|>", "word " * 5000] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(2000)]
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        for text, code in zip(some, tokens.encode_texts(some, tokens.default_vocabulary(), 2)):
            assert code.tolist() == expected(plain, text), text


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(3000))])
def test_codes_are_directly_addressable(ids):
    data = tokens.encode_segment([1, None], [len(ids), 0], np.array(ids, np.uint32))
    seg = tokens.Segment(data)
    assert seg.tokens().tolist() == ids and [seg.token(i) for i in range(len(ids))] == ids
    assert seg.doc_ids == [1, None] and seg.document(0).tolist() == ids and seg.document(1).tolist() == []
    with pytest.raises(IndexError):
        seg.token(len(ids))
    with pytest.raises(ValueError):
        tokens.Segment(b"nothing like a segment")


def test_files_round_trip(spark, plain, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "of", "Straße", "x1", "end.\nNew"], k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "word " * 20000]
    rows = [(i * 7 % 64, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(t, i, "y") for i, t in rows], "text string, doc_id long, part string")
    path = str(tmp_path / "ids")
    tokens.write_tokens(df, path, segment_tokens=500)
    got = sorted(tokens.token_directory(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in rows], key=lambda i: -1 if i is None else i)
    at = 0
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(expected(plain, t))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        crcs = [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in by_id[r.doc_id]]
        assert (r.n_tokens, r.ids_crc32) in crcs
    places = {(r.file, r.segment) for r in got}
    assert len(places) > 4
    for r in got:
        with open(r.file.removeprefix("file:"), "rb") as f:
            data = f.read()
        asked = []
        seg = tokens.Segment(lambda at, n, data=data, asked=asked: asked.append(n) or data[at : at + n], r.segment)
        ids = seg.document(r.k).tolist()
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        asked.clear()
        for t in range(0, r.n_tokens, 37):
            assert seg.token(r.begin + t) == ids[t]
            assert sum(asked) <= 4 * (1 + 8 * tokens.BLOCK_WORDS + 4)  # whatever the size
            asked.clear()
    row = got[-1]
    last = tokens.read_token(spark, row.file, row.segment, row.begin + row.n_tokens - 1)
    assert last == 2


def test_files_roll_and_keep_their_order(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "_FILE_SEGMENTS", 2)
    df = spark.createDataFrame([(i, "some words here") for i in range(200)], "doc_id long, text string")
    tokens.write_tokens(df, str(tmp_path / "ids"), segment_tokens=10)
    got = sorted(tokens.token_directory(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(200)) and [r.start for r in got] == [4 * i for i in range(200)]


def test_another_vocabulary_encodes_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    other, texts = Tokenizer.from_file(path), ["Two  Words\nhere", None, "", "a b c " * 50]
    got = [x.tolist() for x in tokens.encode_texts(texts, path, 7)]
    assert got == [[*other.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_words_beyond_the_cache_and_long_texts(plain, monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE_WORDS", 50)
    encoder = tokens._Encoder(tokens.default_vocabulary())
    rng = random.Random(5)
    long = "".join(rng.choice("ab ,.é") for _ in range(1_200_000)).replace("  ", " x ")
    for at in range(5):
        texts = [f"First{at} " + " ".join(f"w{rng.randint(0, 99)}," for _ in range(40)) for _ in range(20)] + ["word  " + long] * (at == 4)
        ids, sizes = encoder.encode(__import__("pyarrow").array(texts), 2)
        assert ids.tolist() == [i for t in texts for i in expected(plain, t)] and sizes.sum() == len(ids)
    assert len(encoder.known) == 50


def test_empty_table(spark):
    assert tokens.encode_to_directory(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tokens_before_files(spark, tmp_path):
    rows = [(f"file:/x/part-{p:05d}-8f0a-c123-{p}-c{c:03d}.txt", (p * 7 + c) % 5) for p in (*range(12), 100_000, 123_456) for c in range(3)]
    docs = [(name, n) for name, n in rows for _ in range(2)]
    random.Random(4).shuffle(docs)
    got = {r.file: r.before for r in tokens._tokens_before(spark.createDataFrame(docs, "file string, n_tokens long").repartition(5)).collect()}
    at, want = 0, {}
    for name, n in rows:
        want[name] = at
        at += 2 * n
    assert got == want
    assert tokens._tokens_before(spark.createDataFrame([], "file string, n_tokens long")).count() == 0
