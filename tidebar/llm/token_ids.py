"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length code.

A file is a run of blocks, each ended by ``\\n``. A block is a header ``TIDB``, its numbers of documents
(u32), ids (u64) and data bytes (u64), then per document its id (i64), whether the id is known (u8) and
its number of ids (u64), then the control bytes, then the data bytes. A rank below 256 takes one data
byte, below 65,536 two, and so on; two control bits per id tell its number of bytes. The folder
``ranks`` holds ``TIDR``, the number of ranks (u32) and the id of each rank (u32). All numbers are
little-endian. Files are named in order and documents stand in ascending id order.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tidebar.llm.text import byte_column, space_words
from tidebar.sources.scratch import drop, materialize

_HEAD, _RANKS = struct.Struct("<4sIQQ"), struct.Struct("<4sI")
#: Ids that close a block, and blocks in a file. A document is never split.
BLOCK_IDS, FILE_BLOCKS = 1 << 16, 64
#: Distinct chunks in each of the two generations that a worker remembers, and the longest of them in bytes.
MEMO, MEMO_BYTES = 400_000, 64
#: ASCII punctuation other than an apostrophe, after a letter of Latin-1 or a digit, that ends a chunk. The tokenizer splits before it.
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[A-Za-z0-9].)|(?<=\xC3[\x80-\x96\x98-\xB6\xB8-\xBF].))[!-&(-/:-@\[-`{-~]*(?=[\x20\x09-\x0D]|\Z)")
#: A capital that may be composed with what follows, before it is lower-cased. Nothing from U+00C0 to U+00FF is composed with a letter before it.
_COMPOSED = re.compile(rb"[A-Z][\x80-\xC2\xC4-\xFF]")
#: Letters of Latin-1 alone.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
_SMALL = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_CAPITALS = "".join(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
#: Chunks that are encoded on their own: they hold the digit that parts the others, or may hold a special token.
_ALONE = re.compile(r"0|<\|")
#: Bytes of each of the four ids of a control byte.
_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)
_PLACES = np.arange(4, dtype=np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[_PLACES < size[:, None]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Ranks from control and data bytes: lengths come from a table of control bytes."""
    size = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_PLACES < size[:, None]] = data
    return out.view("<u4").reshape(-1)


def pack_block(ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    return b"".join((_HEAD.pack(b"TIDB", len(ids), len(ranks), len(data)), np.array([i or 0 for i in ids], "<i8").tobytes(),
                     np.array([i is not None for i in ids], np.uint8).tobytes(), np.array(counts, "<u8").tobytes(), control, data))


def unpack_blocks(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """``(ids, counts, ranks)`` of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, n, size = _HEAD.unpack_from(content, at)
        if magic != b"TIDB":
            raise ValueError("not a block of token ids")
        at += _HEAD.size
        take = lambda kind, k, width: (np.frombuffer(content, kind, k, at), at + k * width)
        ids, at = take("<i8", docs, 8)
        known, at = take(np.uint8, docs, 1)
        counts, at = take("<u8", docs, 8)
        control, at = take(np.uint8, -(-n // 4), 1)
        data, at = take(np.uint8, size, 1)
        at += 1  # the line end
        yield [i if k else None for i, k in zip(ids.tolist(), known.tolist())], counts.astype(np.int64), unpack_ranks(control, data, n)


class _Memo(dict):
    """Ids of chunks. One that is asked for comes back from the generation before, or ``learn`` gives its ids; where it gives none the chunk is noted down."""

    def __init__(self, old: dict[bytes, bytes], learn: Callable[[bytes], bytes | None]):
        super().__init__()
        self.old, self.learn, self.lacking = old, learn, []

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.learn(chunk)
            if found is None:
                self.lacking.append(chunk)
                return b""
        if len(chunk) <= MEMO_BYTES:
            self[chunk] = found
        return found


class _Encoder:
    """Ids of texts. White space ends every token of this tokenizer, so a text's ids are those of its
    chunks between white space; the library encodes each distinct chunk once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.parting = self.library.encode("0", add_special_tokens=False).ids
        normal, cut = self.library.normalizer, self.library.pre_tokenizer
        self.lowers = normal is not None and normal.normalize_str(_CAPITALS) == _CAPITALS.lower() and normal.normalize_str(_SMALL) == _SMALL
        self.signs = {ord(c): cut.pre_tokenize_str(c)[0][0] for c in _SMALL} if cut is not None else {}  # of the model, for each letter
        whole = self.lowers and cut is not None and [t for t, _ in cut.pre_tokenize_str(_SMALL)] == [_SMALL.translate(self.signs)]
        self.model = self.library.model if whole else None
        self.memo = _Memo({}, self._word)

    def _encode(self, chunks: list[bytes]) -> Iterator[bytes]:
        """Ids of each chunk. Chunks go to the library as one text, parted by a digit: a digit is always a token of its
        own, and no chunk without that digit has its id."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        alone = [len(self.parting) != 1 or _ALONE.search(t) is not None for t in texts]
        joined = " 0 ".join(t for t, x in zip(texts, alone) if not x)
        first, *rest = self.library.encode_batch_fast([joined, *(t for t, x in zip(texts, alone) if x)], add_special_tokens=False)
        ids = np.array(first.ids, "<u4")
        cuts = [-1, *np.flatnonzero(ids == self.parting[0]).tolist(), len(ids)]
        if len(cuts) - 1 != max(1, alone.count(False)):
            raise ValueError("the tokenizer does not keep the parted chunks apart")
        data = ids.tobytes()
        parts, single = (data[4 * a + 4:4 * b] for a, b in zip(cuts, cuts[1:])), (np.fromiter(e.ids, "<u4").tobytes() for e in rest)
        return (next(single if x else parts) for x in alone)

    def _word(self, chunk: bytes) -> bytes | None:
        """Ids of a chunk of letters of Latin-1 alone, which are lower-cased and stay together, so that the model takes them; else none."""
        if self.model is None or not _LETTERS.fullmatch(chunk):
            return None
        word = chunk.decode().lower()
        small = word.encode()
        if small != chunk:
            return self.memo[small]
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word if word.isascii() else word.translate(self.signs))])

    def __call__(self, data: bytes) -> np.ndarray:
        parts = []
        if b"<|" not in data:  # else it may hold a special token, which is looked for in the text as it stands
            if self.lowers and (data.isascii() or not _COMPOSED.search(data)):
                data = data.lower()
            data = _TAIL.sub(rb" \g<0>", data)
        for chunks in space_words(data):
            if len(self.memo) > MEMO:
                self.memo.old = {}
                self.memo = _Memo(self.memo, self._word)
            memo = self.memo
            found = b"".join(map(memo.__getitem__, chunks))
            if memo.lacking:
                new, memo.lacking = set(memo.lacking), []
                memo.update(zip(new, self._encode(list(new))))
                found = b"".join(map(memo.__getitem__, chunks))
                for c in new:
                    if len(c) > MEMO_BYTES:
                        del memo[c]
            parts.append(found)
        return np.frombuffer(b"".join(parts), "<u4")


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One per worker, which later tasks of the worker use again."""
    return _Encoder(path)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, squeeze = _encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = [np.append(encode(t), np.uint32(end_id)) for t in byte_column(batch, "text")]
            packed = [squeeze.compress((x.astype("<u2") if x.max() < 1 << 16 else x.astype("<u4")).tobytes()) for x in ids]
            yield pa.record_batch([batch.column("id"), pa.array([4 if x.max() >= 1 << 16 else 2 for x in ids], pa.int32()), pa.array(packed, pa.binary())], ["id", "width", "packed"])
    return run


def _unsqueeze(batch: pa.RecordBatch) -> list[np.ndarray]:
    open_ = zstandard.ZstdDecompressor()
    return [np.frombuffer(open_.decompress(p), f"<u{w}") for w, p in zip(batch.column("width").to_pylist(), batch.column("packed").to_pylist())]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, waiting, size = np.zeros(0, np.int64), [], 0

    def settled() -> np.ndarray:
        part = np.bincount(np.concatenate(waiting), minlength=len(total))
        part[: len(total)] += total
        return part
    for batch in batches:
        for ids in _unsqueeze(batch):
            waiting.append(ids)
            size += len(ids)
            if size >= BLOCK_IDS * 8:
                total, waiting, size = settled(), [], 0
    if waiting:
        total = settled()
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["token", "n"])


def _pack(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, size = [], [], 0

        def block() -> pa.RecordBatch:
            data = pack_block(docs, [len(x) for x in held], rank_of[np.concatenate(held)])
            return pa.record_batch([pa.array([data], pa.binary())], ["block"])

        for batch in batches:
            for doc, ids in zip(batch.column("id").to_pylist(), _unsqueeze(batch)):
                docs.append(doc)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    docs, held, size = [], [], 0
        if docs:
            yield block()
    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append ``end_id`` and write the files of this module under ``path``.

    Null and blank texts have the end id only. Ids are integers; a null id comes first, rows with the same
    id stand next to each other. Other columns are ignored; an empty table gives no file of ids. Texts
    are encoded once into a written table, from which the ids are counted (one row per token and
    task, the vocabulary in all) and dealt out by ranges of (id, row). Files are written through the
    text source, so they go wherever Spark can write and survive lost tasks."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    coded = source.mapInArrow(_tokenise(tokenizer, end_id), "id long, width int, packed binary")
    coded = materialize(coded.withColumn("row", F.monotonically_increasing_id()), "ids")
    counts = coded.select("width", "packed").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    order = [r.token for r in sorted(counts, key=lambda r: (-r.n, r.token))]  # at most the vocabulary
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    blocks = coded.repartitionByRange("id", "row").sortWithinPartitions("id", "row").mapInArrow(_pack(rank_of), "block binary")
    as_text = F.col("block").cast("string")  # the bytes as they are
    blocks.select(as_text).write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/ids")
    table = _RANKS.pack(b"TIDR", len(order)) + np.array(order, "<u4").tobytes()
    spark.createDataFrame([(bytearray(table),)], "block binary").coalesce(1).select(as_text).write.text(f"{path}/ranks")
    drop(coded)
    return path


def _read(ids_of: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                start = 0
                for docs, counts, ranks in unpack_blocks(content.as_buffer().to_pybytes()):
                    ids = ids_of[ranks]
                    ends = np.cumsum(counts)
                    cuts = list(zip((ends - counts).tolist(), ends.tolist()))
                    columns = [pa.array([name] * len(docs)), pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts),
                               pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.record_batch(columns, ["path", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])
                    start += int(ends[-1])
    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of the documents in the files under ``path``; ``start``
    counts the ids of all documents before it, over all files in order."""
    ranks = bytes(spark.read.format("binaryFile").load(f"{path}/ranks").select("content").first().content)
    ids_of = np.frombuffer(ranks, "<u4", _RANKS.unpack_from(ranks)[1], _RANKS.size)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("path", "content")
    kind = "path string, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = files.mapInArrow(_read(ids_of, with_ids), kind)
    sizes = files.mapInArrow(_sizes, "path string, n long").select(
        "path", "n", F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("part"), F.regexp_extract("path", r"-c(\d+)", 1).cast("long").alias("file"))
    # ids before a file: those of its partition's earlier files, and those of earlier partitions, of which there are few
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(W.orderBy("part")).alias("base"))
    sizes = sizes.select("path", "part", before(W.partitionBy("part").orderBy("file")).alias("inside"))
    offsets = sizes.join(parts, "part").select("path", (F.col("inside") + F.col("base")).alias("offset"))
    return docs.join(offsets, "path").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in each file, from the block headers alone."""
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data, at, total = memoryview(content.as_buffer()), 0, 0
            while at < len(data):
                _, docs, n, size = _HEAD.unpack_from(data, at)
                total += n
                at += _HEAD.size + 17 * docs + -(-n // 4) + size + 1
            yield pa.record_batch([pa.array([name]), pa.array([total], pa.int64())], ["path", "n"])
