"""Token ids in directly addressable codes (DAC): any token can be read without its block.

A file is a run of segments, each followed by a line end. A segment holds the tokens of
consecutive documents:

    magic "CKDAC002" | uint32 documents, levels | uint64 tokens
    for each level: uint64 codes | uint64 place of its chunks in the segment
    int64 id of each document | uint8 1 if that id is not null | uint64 end of each document
    for each level: chunks (one byte each) | continuation bitmap, 64-bit words
                    | uint32 rank at each bitmap block

Level 0 has the lowest ``BITS`` bits of each id. Bit i of a level's bitmap says that code i
goes on; the number of such bits before it, which the rank directory and the popcount of
at most one block give, is its place in the next level. All numbers are little-endian.
Nothing is compressed, so that a token is read by a few reads of known place and size.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._common import bound_batches, drop_worker_caches, materialize, new_path, pieces, worker_cache

MAGIC = b"CKDAC002"
BITS = 8
#: 64-bit bitmap words per entry of the rank directory.
BLOCK_WORDS = 8
#: Words whose ids a worker keeps, and the longest first word of a text that it keeps.
_CACHE_WORDS, _LONGEST = 600_000, 64
#: Bytes of text that are encoded together.
_TOGETHER = 5 << 20
#: Segments of a file, about; a task begins another file then.
_FILE_SEGMENTS = 8
_SPECIAL = "<|"
_HEAD, _LEVEL = struct.Struct("<8sIIQ"), struct.Struct("<QQ")


def encode_levels(ids: np.ndarray) -> list[tuple[int, bytes, bytes, bytes]]:
    """(codes, chunks, bitmap, rank directory) of each level of ``ids`` (unsigned)."""
    out, now = [], ids.astype(np.uint32)
    while True:
        more = now >> BITS > 0
        words = np.zeros(-(-len(now) // 64), np.uint64)
        packed = np.packbits(more, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        counts = np.add.reduceat(np.bitwise_count(words).astype(np.uint32), np.arange(0, len(words), BLOCK_WORDS)) if len(words) else np.zeros(0, np.uint32)
        rank = np.concatenate((np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)))
        out.append((len(now), (now & (1 << BITS) - 1).astype(np.uint8).tobytes(), words.tobytes(), rank.tobytes()))
        now = now[more] >> BITS
        if not len(now):
            return out


def encode_segment(doc_ids: list[int | None], lengths: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment."""
    levels = encode_levels(ids)
    at = _HEAD.size + _LEVEL.size * len(levels) + 17 * len(doc_ids)
    parts = [_HEAD.pack(MAGIC, len(doc_ids), len(levels), len(ids))]
    for n, *sections in levels:
        parts.append(_LEVEL.pack(n, at))
        at += sum(map(len, sections))
    parts += [
        np.array([d or 0 for d in doc_ids], np.int64).tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.cumsum(np.array(lengths, np.uint64), dtype=np.uint64).tobytes(),
    ]
    for _, *sections in levels:
        parts += sections
    return b"".join(parts)


class Segment:
    """Reads the segment at ``at`` of ``source``: bytes, or a function (place, size) that
    reads as many bytes there. ``token(i)`` asks for one byte, one bitmap block and one
    rank of each level that the token reaches, whatever the segment's size."""

    def __init__(self, source: bytes | memoryview | Callable[[int, int], bytes], at: int = 0):
        self.read = source if callable(source) else lambda place, size: source[place : place + size]
        self.at = at
        head = bytes(self.read(at, _HEAD.size))
        if head[:8] != MAGIC:
            raise ValueError("not a token segment")
        _, self.n_docs, n, self.n_tokens = _HEAD.unpack(head)
        self.levels = list(_LEVEL.iter_unpack(bytes(self.read(at + _HEAD.size, _LEVEL.size * n))))
        last, place = self.levels[-1]
        self.size = place + self._places(last)[2]

    @staticmethod
    def _places(n: int) -> tuple[int, int, int]:
        """Where, from its chunks on, a level of ``n`` codes has its bitmap, ranks and end."""
        words = -(-n // 64)
        return n, n + 8 * words, n + 8 * words + 4 * (-(-words // BLOCK_WORDS) + 1)

    def _take(self, kind, place: int, n: int) -> np.ndarray:
        return np.frombuffer(self.read(self.at + place, n * np.dtype(kind).itemsize), kind)

    def token(self, i: int) -> int:
        """Token ``i`` of the segment, by access and rank alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (n, place) in enumerate(self.levels):
            bitmap, ranks, _ = self._places(n)
            value |= int(self._take("u1", place + i, 1)[0]) << BITS * level
            word, bit = divmod(i, 64)
            block = word // BLOCK_WORDS
            first = block * BLOCK_WORDS
            words = self._take("<u8", place + bitmap + 8 * first, word + 1 - first)
            if not int(words[-1]) >> bit & 1:
                return value
            rank = int(self._take("<u4", place + ranks + 4 * block, 1)[0])
            i = rank + int(np.bitwise_count(words[:-1]).sum()) + (int(words[-1]) & (1 << bit) - 1).bit_count()
        raise ValueError("a code goes on after the last level")

    def tokens(self) -> np.ndarray:
        """All ids, as unsigned 32-bit integers."""
        above = np.zeros(0, np.uint32)
        for n, place in reversed(self.levels):
            now = self._take("u1", place, n).astype(np.uint32)
            bitmap = self._take("u1", place + n, 8 * -(-n // 64))
            more = np.unpackbits(bitmap, bitorder="little", count=n).astype(bool)
            now[more] |= above << np.uint32(BITS)
            above = now
        return above

    @property
    def doc_ids(self) -> list[int | None]:
        place = _HEAD.size + _LEVEL.size * len(self.levels)
        ids, has = self._take("<i8", place, self.n_docs), self._take("u1", place + 8 * self.n_docs, self.n_docs)
        return [int(d) if h else None for d, h in zip(ids, has, strict=True)]

    @property
    def ends(self) -> np.ndarray:
        """Where each document's tokens end in the segment."""
        return self._take("<u8", _HEAD.size + _LEVEL.size * len(self.levels) + 9 * self.n_docs, self.n_docs)

    def document(self, k: int) -> np.ndarray:
        """The ids of the segment's document ``k``."""
        ends = self.ends
        return self.tokens()[int(ends[k - 1]) if k else 0 : int(ends[k])]


def segments_of(content: bytes | memoryview) -> Iterator[Segment]:
    """The segments of a file, in order."""
    at = 0
    while at < len(content):
        found = Segment(content, at)
        yield found
        at += found.size + 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Encoding ---------------------------------------------------------------------------------

#: The code of a word by which its text must be encoded whole.
_WHOLE = -1


class _Encoder:
    """Encodes texts by the ids of their words, which it keeps in one array."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        #: Whether words can be encoded by themselves.
        self.splits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer")
        self.sizes = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab().items():
            self.sizes[i] = len(token)  # one character for each byte
        #: Known words; the code of each is its place among them and 2. Code 0 has no ids.
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.firsts: dict[str, np.ndarray] = {}

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, encoded as it stands. Long texts are cut before a single space
        between other characters, where the splitter always cuts."""
        out: list[np.ndarray] = []
        for text in texts:
            parts, at = [], 0
            if self.splits and _SPECIAL not in text:
                while len(text) - at > 1 << 20:
                    cut = next((m.start() + 1 for m in re.compile(r"\S \S").finditer(text, at + (1 << 19))), None)
                    if cut is None:
                        break
                    parts.append(text[at:cut])
                    at = cut
            parts.append(text[at:])
            found = [np.array(self.tok.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.uint32) for x in parts]
            out.append(np.concatenate(found))
        return out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and where each one's end: of a space and the word, or of the
        word alone if it begins with a line end. All are encoded as one text, and the bytes
        that its ids stand for say where a word ends."""
        text = (" " + " ".join(words)).replace(" \n", "\n")
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self.sizes[ids])
        data = np.frombuffer(text.encode(), np.uint8)
        wanted = np.append(np.flatnonzero((data == 0x20) | (data == 0x0A))[1:], len(data))
        at = np.searchsorted(ends, wanted)
        if len(ends) != at[-1] + 1 or not np.array_equal(ends[at], wanted):
            raise ValueError("the tokenizer joined what stands before and after a space")
        return ids, at + 1

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; number of ids of each text).

        The byte-level splitter never joins what stands before a single space or line end,
        after which something else follows, to what stands after it. So a text is encoded
        in words that begin there, each distinct word once, and words seen before, up to a
        bound, are looked up. Texts with more white space in one place, with special
        tokens, or for another kind of splitter, are encoded whole.
        """
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.splits:
            found = self.plain(texts.to_pylist())
            end = np.array([end_id], np.uint32)
            return np.concatenate([x for ids in found for x in (ids, end)]), np.array([len(x) + 1 for x in found], np.int64)
        if len(self.firsts) > _CACHE_WORDS // 8:
            self.firsts.clear()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        off = lists.offsets.to_numpy()
        off = off - off[0]
        words = lists.flatten().dictionary_encode()
        distinct, indices = words.dictionary, words.indices.to_numpy()
        # Ids that only these texts need stand behind those that are kept.
        ids, ends = [self.ids, np.array([end_id], np.uint32)], [self.ends, np.array([len(self.ids) + 1])]
        size, made = len(self.ids) + 1, len(self.ends) + 1

        def add(new: np.ndarray, new_ends: np.ndarray) -> np.ndarray:
            """The codes of new words, given their ids and where each one's end."""
            nonlocal size, made
            ids.append(new)
            ends.append(new_ends + size)
            size, made = size + len(new), made + len(new_ends)
            return np.arange(made - len(new_ends), made)

        of = pc.index_in(distinct, self.known)
        fresh = of.is_null().to_numpy(zero_copy_only=False)
        of = pc.fill_null(of, 0).to_numpy().astype(np.int64) + 2
        of[fresh] = _WHOLE
        fresh = np.flatnonzero(fresh)
        new = distinct.take(pa.array(fresh))
        fresh, alone = fresh[(ok := self._alone(new))], new.filter(pa.array(ok))
        for at in range(0, len(fresh), 20_000):
            of[fresh[at : at + 20_000]] = add(*self._words(alone.slice(at, 20_000).to_pylist()))
        code = of[indices]
        # First words stand without a space before them.
        starts = off[:-1]
        first = distinct.take(pa.array(indices[starts])).to_pylist()
        good = [one or bool(w) and not w[-1].isspace() for w, one in zip(first, (np.diff(off) == 1).tolist(), strict=True)]
        good &= ~pc.match_substring(texts, _SPECIAL).to_numpy(zero_copy_only=False)
        local: dict[str, int] = {}
        for w, ok in zip(first, good.tolist(), strict=True):
            if ok and w not in local:
                one = self.firsts.get(w)
                one = self.plain([w])[0] if one is None else one
                if len(w) <= _LONGEST:
                    self.firsts[w] = one
                local[w] = int(add(one, np.array([len(one)]))[0])
        code[starts] = [local[w] if ok else _WHOLE for w, ok in zip(first, good.tolist(), strict=True)]
        whole = np.logical_or.reduceat(code == _WHOLE, starts)
        code[np.repeat(whole, np.diff(off))] = 0
        closing = np.full(len(texts), len(self.ends))
        for i in np.flatnonzero(whole).tolist():
            one = np.append(self.plain([texts[i].as_py()])[0], np.uint32(end_id))
            closing[i] = add(one, np.array([len(one)]))[0]
        code = np.insert(code, off[1:], closing)
        ids, ends = np.concatenate(ids), np.concatenate(ends)
        n = np.diff(ends, prepend=0)[code]
        to = np.cumsum(n)
        kind = np.int32 if max(int(to[-1]), len(ids)) < 1 << 31 else np.int64
        place = np.repeat((ends[code] - to).astype(kind), n)
        place += np.arange(int(to[-1]), dtype=kind)
        out = ids[place]
        room = _CACHE_WORDS - len(self.known)
        if room > 0 and len(fresh) and alone.nbytes < 64 << 20:
            keep = min(room, len(fresh))
            last, begin = int(of[fresh[keep - 1]]), int(of[fresh[0]])
            low = int(ends[begin - 1])
            self.ends = np.concatenate([self.ends, ends[begin : last + 1] - low + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids[low : int(ends[last])]])
            self.known = pa.concat_arrays([self.known, alone.slice(0, keep)])
        return out, np.add.reduceat(n, off[:-1] + np.arange(len(texts)))

    @staticmethod
    def _alone(words: pa.Array) -> np.ndarray:
        """Which words can be encoded by themselves: without white space at their ends, but
        for a line end before them."""
        cut = lambda a, b: pc.utf8_is_space(pc.utf8_slice_codeunits(words, a, b)).to_numpy(zero_copy_only=False)
        some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        line = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        return some & ~cut(-1, None) & np.where(line, ~cut(1, 2), ~cut(0, 1))


def _encoder(path: str) -> _Encoder:
    return worker_cache(("tokens", path), lambda: _Encoder(path))


def encode_texts(texts: list[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """Per text its ids and ``end_id``."""
    ids, sizes = _encoder(path).encode(pa.array(texts, pa.large_string()), end_id)
    return np.split(ids, np.cumsum(sizes)[:-1])


# Files ------------------------------------------------------------------------------------


def _writer(vocabulary: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, codes, size
            data = encode_segment(ids, np.concatenate(lengths), np.concatenate(codes))
            ids, lengths, codes, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()).view(pa.string())], names=["value"])

        for batch in batches:
            for some in pieces(batch, 1, _TOGETHER):
                found, sizes = encoder.encode(some.column(1), end_id)
                names, to, at = some.column(0).to_pylist(), np.cumsum(sizes), 0
                while at < len(names):
                    begin = int(to[at - 1]) if at else 0
                    last = min(len(names), int(np.searchsorted(to, begin + most - size)) + 1)
                    ids += names[at:last]
                    lengths.append(sizes[at:last])
                    codes.append(found[begin : int(to[last - 1])])
                    size += len(codes[-1])
                    at = last
                    if size >= most:
                        yield flush()
        if ids:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 2,
    segment_tokens: int = 1 << 20,
) -> None:
    """Encode whole texts and write their ids to files in ``path``, in ascending id order.

    The texts are dealt out by ranges of id once, and encoded where they arrive; each
    task writes segments of about ``segment_tokens`` tokens (never cutting a document) to
    files of about 8 segments, through the engine's commit protocol, which keeps a lost
    task's remains out. Ids are integers (others must be cast before; a value that is no
    integer fails); null ids come first; rows with the same id are ordered by a hash of the
    text. Null and empty texts have the end id only. Any vocabulary of the tokenizers
    library will do; with one that is not byte-level, texts are encoded whole. Other
    columns are not read; an empty table gives files without segments.
    """
    vocabulary = vocabulary or default_vocabulary()
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = rows.mapInArrow(_writer(vocabulary, end_id, segment_tokens), "value string")
    made.write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", _FILE_SEGMENTS).text(path)


_ENTRY = "file string, segment long, k int, doc_id long, first long, begin long, n_tokens long, ids_crc32 long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directory rows of whole files (path, content)."""
    drop_worker_caches()
    for batch in batches:
        for row in range(batch.num_rows):
            name, before = batch.column(0)[row].as_py(), 0
            content = memoryview(batch.column(1)[row].as_buffer())
            for seg in segments_of(content):
                raw = memoryview(seg.tokens().astype("<u4").tobytes())
                ends = seg.ends.astype(np.int64)
                begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = seg.n_docs
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n, pa.string()), pa.array(np.full(n, seg.at)), pa.array(np.arange(n, dtype=np.int32)), pa.array(seg.doc_ids, pa.int64()),
                        pa.array(begins + before), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64()),
                    ],
                    names=[x.split()[0] for x in _ENTRY.split(", ")],
                )
                before += seg.n_tokens


def _tokens_before(rows: DataFrame) -> DataFrame:
    """(file, before): the tokens of all files before each, in the order in which they were
    written. Files are dealt out by ranges of that order; one sum for each range comes to
    the driver."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")
    piece = F.coalesce(F.nullif(F.regexp_extract("file", r"-c(\d+)(?:\.[a-z]+)*$", 1), F.lit("")).cast("long"), F.lit(0))
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumns({"part": part, "piece": piece})
    dealt = materialize(sums.repartitionByRange(parts, "part", "piece").withColumn("range", F.spark_partition_id()), "files")
    starts, at = [], 0
    for number, n in sorted((r[0], r[1]) for r in dealt.groupBy("range").agg(F.sum("n")).collect()):
        starts += [F.lit(number), F.lit(at).cast("long")]
        at += n
    within = Window.partitionBy("range").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    add = F.create_map(*starts)[F.col("range")] if starts else F.lit(0)
    return dealt.select("file", (F.coalesce(F.sum("n").over(within), F.lit(0)) + add).cast("long").alias("before"))


def token_directory(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``, read back from them: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32, and where it is: file, segment (its place in
    the file), k (its number in the segment), begin (its first token in the segment).

    What precedes a file is a table that is joined as its size allows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = materialize(files.mapInArrow(_entries, _ENTRY), "directory")
    out = rows.join(_tokens_before(rows), "file")
    return out.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "segment", "k", "begin")


def read_token(spark: SparkSession, file: str, segment: int, i: int) -> int:
    """Token ``i`` of the segment at place ``segment`` of ``file``, read by seeking: well
    under 1 KB of any file that Spark can open. With a row of ``token_directory``, a
    document's token t is ``read_token(spark, file, segment, begin + t)``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)

    def read(place: int, size: int) -> bytes:
        stream.seek(place)
        return bytes(stream.readNBytes(size))

    try:
        return Segment(read, segment).token(i)
    finally:
        stream.close()


def encode_to_directory(docs: DataFrame, **how) -> DataFrame:
    """``write_tokens`` to a new path of the shared folder; doc_id, start, n_tokens and
    ids_crc32 of its ``token_directory``."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **how)
    return token_directory(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
