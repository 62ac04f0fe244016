"""Files of token ids in bit or byte planes.

Ids are cut into blocks of fixed size. A block is transposed: plane k holds byte
k (or bit k) of all its ids, each plane is compressed with zstandard on its own,
and planes of zeros are left out. A file holds a head, its blocks and a tail with
the chunk index (place, number of ids, checksum and plane lengths of every block)
and the document index (id and number of tokens in file order), so that a reader
finds the ids of any document without reading other blocks.

The documents are range-partitioned by id; every partition is encoded and written
as one file by Spark's own writer, on whatever file system the folder is, and
part-00000, part-00001, ... hold the documents in ascending order of their ids.
Segments of a file end with a line feed, as that writer closes its records with
one; nothing depends on its value. Lost tasks are run again and commit once.

Null text counts as empty: its document is the end id alone. A null id comes
before all others. Equal ids stand in an order fixed by their texts; rows of one
id are dealt to several files if they are many. An empty table gives a folder
without documents. Columns other than doc_id and text are not read. A task holds
one block, its document index and one batch of texts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwheel.llm.bpe import codec
from cartwheel.llm.packing import RANKS, TOKENIZER, added_tokens
from cartwheel.llm.rows import slim, texts
from cartwheel.session import new_path, written

END_ID = 2
#: UTF-8 bytes of text that one file is planned for.
FILE_BYTES = 1 << 27

HEAD, TAIL = b"IDPLANE1", b"1ENALPDI"
_HEAD = struct.Struct("<8sBI")
_TAIL = struct.Struct("<QQQQ8s")
_LF = 1


class Layout(NamedTuple):
    """Ids per block, bits per plane (1 or 8) and level of the compressor."""

    block: int = 1 << 16
    bits: int = 8
    level: int = 3

    @property
    def planes(self) -> int:
        return 32 // self.bits


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block, lowest first; planes of zeros are empty."""
    columns = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits == 1:
        columns = np.vstack([(column[None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1 for column in columns])
    return [(np.packbits(c) if bits == 1 else c).tobytes() if c.any() else b"" for c in columns]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        if plane:
            column = np.frombuffer(plane, np.uint8)
            column = np.unpackbits(column, count=n) if bits == 1 else column
            ids |= column.astype(np.uint32) << np.uint32(k * bits)
    return ids


class Writer:
    """Turns the documents of one file into its segments."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.zip = zstandard.ZstdCompressor(level=layout.level).compress
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.at = 0
        self.chunks: list[tuple[int, int, int]] = []
        self.lengths: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def _segment(self, payload: bytes) -> bytes:
        self.at += len(payload) + _LF
        return payload

    def head(self) -> bytes:
        return self._segment(_HEAD.pack(HEAD, self.layout.bits, self.layout.block))

    def _chunk(self, ids: np.ndarray) -> bytes:
        planes = [self.zip(p) if p else b"" for p in to_planes(ids, self.layout.bits)]
        self.chunks.append((self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        self.lengths.append([len(p) for p in planes])
        return self._segment(b"".join(planes))

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.layout.block:
            held, size = np.concatenate(self.waiting), self.layout.block
            whole = len(held) - len(held) % size
            for start in range(0, whole, size):
                yield self._chunk(held[start : start + size])
            self.waiting, self.held = [held[whole:].copy()], len(held) - whole

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self._chunk(np.concatenate(self.waiting))
        index = b"".join(
            (
                np.array([c[0] for c in self.chunks], "<u8").tobytes(),
                np.array([c[1] for c in self.chunks], "<u4").tobytes(),
                np.array([c[2] for c in self.chunks], "<u4").tobytes(),
                np.array(self.lengths, "<u4").tobytes(),
                np.array([i or 0 for i in self.doc_ids], "<i8").tobytes(),
                np.array([i is None for i in self.doc_ids], "u1").tobytes(),
                np.array(self.counts, "<u8").tobytes(),
            )
        )
        packed = self.zip(index)
        tail = _TAIL.pack(len(packed), len(self.chunks), len(self.counts), sum(self.counts), TAIL)
        yield self._segment(packed + tail)


class Reader:
    """Documents and blocks of one file."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        magic, self.bits, self.block = _HEAD.unpack_from(content)
        size, n_chunks, n_docs, self.n_ids, closing = _TAIL.unpack_from(content, len(content) - _LF - _TAIL.size)
        if magic != HEAD or closing != TAIL:
            raise ValueError("not a file of id planes")
        end = len(content) - _LF - _TAIL.size
        index = zstandard.ZstdDecompressor().decompress(content[end - size : end])
        at = 0

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(index, kind, n, at)
            at += values.nbytes
            return values

        planes = 32 // self.bits
        self.offsets, self.sizes, self.crcs = column("<u8", n_chunks), column("<u4", n_chunks), column("<u4", n_chunks)
        self.lengths = column("<u4", n_chunks * planes).reshape(n_chunks, planes)
        ids, null = column("<i8", n_docs), column("u1", n_docs)
        self.doc_ids = [None if gone else i for i, gone in zip(ids.tolist(), null.tolist(), strict=True)]
        self.counts = column("<u8", n_docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def chunk(self, k: int) -> np.ndarray:
        """The ids of block k, checked."""
        unzip, at, planes = zstandard.ZstdDecompressor().decompress, int(self.offsets[k]), []
        for length in self.lengths[k].tolist():
            planes.append(unzip(self.content[at : at + length]) if length else b"")
            at += length
        ids = from_planes(planes, int(self.sizes[k]), self.bits)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crcs[k]:
            raise ValueError(f"block {k} is damaged")
        return ids

    def pieces(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(number of the document, ids, whether they are its last), one block at a time."""
        k, block, at = -1, np.empty(0, np.uint32), 0
        for number, left in enumerate(self.counts.tolist()):
            while True:
                if left and at == len(block):
                    k, at = k + 1, 0
                    block = self.chunk(k)
                taken = block[at : at + left]
                at += len(taken)
                left -= len(taken)
                yield number, taken, not left
                if not left:
                    break

    def document(self, number: int) -> np.ndarray:
        """The ids of one document, from the blocks that hold it."""
        start = int(self.starts[number])
        end = start + int(self.counts[number])
        first, last = start // self.block, max(start, end - 1) // self.block
        parts = [self.chunk(k) for k in range(first, last + 1)] if end > start else []
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        return ids[start - first * self.block : end - first * self.block]


@lru_cache(maxsize=4)
def _encoding(ranks: str, tokenizer: str) -> tiktoken.Encoding:
    own = {token: rank for rank, token in enumerate(codec(ranks).bytes_of) if token}
    return tiktoken.Encoding(
        "ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens=added_tokens(tokenizer)
    )


def in_order(docs: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """doc_id and text in files' worth of ascending ids, each sorted.

    The text's hash and a number of the row split the rows of one id, so that no
    id is too hot for a file.
    """
    own = slim(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    keys = ["doc_id", "hash", "number"]
    keyed = own.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    return keyed.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_ids(
    docs: DataFrame,
    folder: str,
    layout: Layout = Layout(),
    end_id: int = END_ID,
    ranks: str | None = None,
    tokenizer: str | None = None,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Encode all texts and write their ids, each document closed by ``end_id``.

    ``ranks`` is the rank file of the vocabulary, ``tokenizer`` the file that
    names its added tokens, which are one id each wherever they stand in a text.
    """
    ranks, tokenizer = ranks or public_tokenizers.path(RANKS), tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = _encoding(ranks, tokenizer).encode_to_numpy, Writer(layout)
        for batch in batches:
            for doc_id, text in texts(batch):
                ids = np.append(encode(text, allowed_special="all"), np.uint32(end_id))
                if not writer.at:
                    yield _record(writer.head())
                yield from map(_record, writer.add(doc_id, ids))
        if writer.at:
            yield from map(_record, writer.close())

    segments = in_order(docs, file_bytes).mapInArrow(run, "segment binary")
    lines = segments.select(F.col("segment").cast("string").alias("value"))
    lines.write.option("compression", "none").option("lineSep", "\n").text(folder)


def _record(segment: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], ["segment"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").load(folder).where("length > 0")
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "content")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """file, place there, doc_id and ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader, parts = Reader(content.as_py()), []
                for number, ids, last in reader.pieces():
                    parts.append(ids)
                    if last:
                        row = [[file], [number], [reader.doc_ids[number]], [np.concatenate(parts)]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["file", "place", "doc_id", "ids"]
                        )
                        parts = []

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    return _files(spark, folder).mapInArrow(run, "file long, place long, doc_id long, ids array<int>")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk index: file, chunk, its place, ids, checksum and compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = Reader(content.as_py())
                n = len(reader.offsets)
                columns = [[file] * n, range(n), reader.offsets, reader.sizes, reader.crcs, reader.lengths.sum(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    names = ["file", "chunk", "start", "n_ids", "ids_crc32", "n_bytes"]
    return _files(spark, folder).mapInArrow(run, ", ".join(f"{name} long" for name in names))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """file, place, doc_id, ids before it in its file, number and crc32 of its ids; no document is put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = Reader(content.as_py())
                crcs = [0] * len(reader.counts)
                for number, ids, _ in reader.pieces():
                    crcs[number] = zlib.crc32(ids.astype("<u4").tobytes(), crcs[number])
                n = len(crcs)
                columns = ([file] * n, range(n), reader.doc_ids, reader.starts, reader.counts, crcs)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    names = ["file", "place", "doc_id", "before", "n_tokens", "ids_crc32"]
    return _files(spark, folder).mapInArrow(run, ", ".join(f"{name} long" for name in names))


def report(docs: DataFrame, layout: Layout = Layout(), folder: str | None = None) -> DataFrame:
    """Write ``docs`` and tell from the files: doc_id, start, n_tokens, ids_crc32, file and place.

    The files' totals, one row each, are cumulated in one window.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "id-planes")
    write_ids(docs, folder, layout)
    rows = written(digests(spark, folder), "id-digests")
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return rows.join(bases, "file").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "place"
    )
