"""Byte-level BPE over whole documents as a tree reduction.

A text is cut in halves down to leaves of at most ``leaf`` characters. Leaves are
encoded on their own, neighbours are joined by encoding a window around the cut
again. The window grows on either side until it starts and ends at a place where
a match of the split pattern begins whatever stands around it: a single space
between two word characters. No match spans such a place and no look-ahead
reaches over it, so all tokens outside of the window are those of the whole
text. Where there is no such place the window grows to the whole node.

Nulls count as empty text; empty text has no ids. Equal rows give equal results,
rows of an empty table none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.rows import slim, texts

MULTI = "byte_bpe_multi_50k.tiktoken"
LEAF = 8192
WINDOW = 64
_ANCHOR = re.compile(r"\w \w")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, joins int"


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker and rank file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks)


class Codec:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = encoding.encode_ordinary
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.joins = 0

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return self._node(text, 0, len(text), leaf)

    def _node(self, text: str, start: int, end: int, leaf: int) -> list[int]:
        if end - start <= leaf:
            return self.plain(text[start:end])
        cut = (start + end) // 2
        return self._join(text, start, cut, end, self._node(text, start, cut, leaf), self._node(text, cut, end, leaf))

    def _join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        self.joins += 1
        width = WINDOW
        while (low := cut - width) > start and not (found := _ANCHOR.search(text, low, cut)):
            width *= 2
        low = found.start() + 1 if low > start else start
        width = WINDOW
        while (high := cut + width) < end and not (found := _ANCHOR.search(text, cut, high)):
            width *= 2
        high = found.start() + 1 if high < end else end
        before = len(left) - len(self.plain(text[low:cut])) if low > start else 0
        after = len(self.plain(text[cut:high])) if high < end else len(right)
        return [*left[:before], *self.plain(text[low:high]), *right[after:]]

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            bytes_of = self.bytes_of
            return b"".join([bytes_of[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


def round_trip(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Digests of the ids of every text and of the bytes they decode to."""
    path = path or public_tokenizers.path(MULTI)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in texts(batch):
                own.joins = 0
                ids = own.encode(text, leaf)
                packed = np.asarray(ids, dtype="<u4").tobytes()
                out.append(
                    (
                        doc_id,
                        len(ids),
                        hashlib.sha256(packed).hexdigest(),
                        hashlib.sha256(own.decode(ids)).hexdigest(),
                        own.joins,
                    )
                )
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "joins")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    return slim(docs).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and the ids themselves."""
    path = path or public_tokenizers.path(MULTI)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = [(doc_id, own.encode(text, leaf)) for doc_id, text in texts(batch)]
            ids = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return slim(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of ``encoded``; bytes that are not UTF-8 become U+FFFD."""
    path = path or public_tokenizers.path(MULTI)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts_out = [own.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_out, pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
