"""Alignment of two tokenizers, and how often their ids meet.

A space and the text are encoded by tokenizer A (byte-level BPE), the text by
tokenizer B (pieces, which adds the space). Byte offsets where tokens of both end
cut the tokens into groups; all occurrences of A and B in one group are linked.
The count of an id pair is the number of documents that hold it linked.

First pass: documents are encoded and aligned in blocks of some ``BLOCK`` bytes.
A block is written with its ids and, per bucket of A ids, its distinct pairs and
in how many of its documents each is linked.

Counting: the distinct pairs of a bucket are united up a tree of blocks, and a
minimal perfect hash is built on them. Blocks then add their counts into dense
vectors indexed by that hash, which are summed up the same tree. A table of a
bucket keeps hash, keys (a lookup is verified by them), counts and which pairs
are the best of their A id; an id's pairs are all in one bucket.

Second pass: the blocks' distinct pairs are looked up, and every block, joined
with its answers, is aligned again from its ids for the sums of its documents.
Tables and answers meet in groups of at most ``FAN`` blocks per bucket, so no
task holds more than that, however common a pair is.

Texts that are null or empty, or whose tokens do not spell space and text, have
no tokens: zeros and an empty digest. Equal rows are as many documents. An empty
table gives no rows. Only doc_id and text are read; a null doc_id stays null.
Very long texts are blocks of their own.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.bpe import codec
from cartwheel.llm.rows import slim, texts
from cartwheel.session import written

#: Ranks of the vocabulary of byte_bpe_50k.json; without its added token texts are plain texts.
RANKS_A = "byte_bpe_50k.tiktoken"
MODEL_B = "piece_bpe_32k.model"
BLOCK = 1 << 20
BUCKETS = 32
FAN = 32
#: Links that are laid out at once.
LINKS = 1 << 20
WIDE = 1 << 12
TASK_SHIFT = 32


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0 .. n - 1.

    Keys that meet no other in a bit array of twice their number stay there, the
    rest goes on to the next array; a key's index is the rank of its bit.
    """

    ROOM = 2
    MAX_LEVELS = 200

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())
        self.size = before

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (((_mixed(keys, level + 1) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == cls.MAX_LEVELS:
                raise ValueError("keys are not distinct")
            at = cls._place(keys, len(levels), cls.ROOM * len(keys))
            alone = np.bincount(at, minlength=cls.ROOM * len(keys)) == 1
            levels.append(alone.astype(np.int64))
            keys = keys[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key; of one that is not in the set, any index or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(keys[left], level, len(bits))
            here = bits[at] == 1
            out[left[here]] = ranks[at[here]]
            left = left[~here]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return sizes.tobytes() + b"".join(np.packbits(bits.astype(bool)).tobytes() for bits in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u8", 1)[0])
        at, levels = 8 * (n + 1), []
        for size in np.frombuffer(data, "<u8", n, 8).tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(np.int64))
            at += -(-size // 8)
        return cls(levels)


class Pieces:
    """Tokenizer B with the bytes of its pieces."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.plain = model.encode
        self.bytes_of = [
            bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
        ]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_NO_IDS = np.empty(0, np.uint32)


class Side(NamedTuple):
    """Ids of all documents of a block one after the other, how many each has, and the bytes of each."""

    ids: np.ndarray
    counts: np.ndarray
    widths: np.ndarray


class Aligned:
    """Documents of a block with their tokens in common groups."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(a.widths), np.cumsum(b.widths)
        size = int(ends_a[-1]) if len(ends_a) else 0
        cuts = np.zeros(size + 1, bool)
        cuts[ends_a] = True
        of_b = np.zeros(size + 1, bool)
        of_b[ends_b] = True
        cuts &= of_b
        done = np.cumsum(cuts)
        self.n = int(done[-1])
        self.group_a, self.group_b = done[ends_a] - cuts[ends_a], done[ends_b] - cuts[ends_b]
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=self.n), np.bincount(self.group_b, minlength=self.n)
        self.first_a, self.first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        # Document of every token of A, and of every group.
        self.doc_a = np.repeat(np.arange(len(a.counts)), a.counts)
        self.doc = np.zeros(self.n, np.int64)
        self.doc[self.group_a] = self.doc_a

    def per_document(self, of_groups: np.ndarray | None = None) -> np.ndarray:
        sums = np.bincount(self.doc, of_groups, minlength=len(self.a.counts))
        return sums.astype(np.int64)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, occurrences) of all links; a pair of a document may come several times."""
        wide = self.size_a * self.size_b > WIDE
        times = np.where(wide, 0, self.size_b)[self.group_a]
        upto = np.cumsum(times)
        low = 0
        while low < len(times):
            before = int(upto[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(upto, before + LINKS, "right")))
            times_, group = times[low:high], self.group_a[low:high]
            own = np.repeat(np.arange(low, high), times_)
            nth = np.arange(len(own)) - np.repeat(upto[low:high] - times_ - before, times_)
            other = np.repeat(self.first_b[group], times_) + nth
            yield self.doc_a[own], _pairs(self.a.ids[own], self.b.ids[other]), np.ones(len(own), np.int64)
            low = high
        for g in np.flatnonzero(wide).tolist():
            ids_a, n_a = np.unique(self._of(self.a.ids, self.first_a, self.size_a, g), return_counts=True)
            ids_b, n_b = np.unique(self._of(self.b.ids, self.first_b, self.size_b, g), return_counts=True)
            step = max(1, LINKS // len(ids_b))
            for at in range(0, len(ids_a), step):
                part = _pairs(np.repeat(ids_a[at : at + step], len(ids_b)), np.tile(ids_b, len(ids_a[at : at + step])))
                yield np.full(len(part), self.doc[g]), part, np.outer(n_a[at : at + step], n_b).ravel()

    @staticmethod
    def _of(ids: np.ndarray, first: np.ndarray, size: np.ndarray, group: int) -> np.ndarray:
        return ids[first[group] : first[group] + size[group]]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs, and in how many documents each is linked."""
        documents, keys = [], []
        for doc, pair, _ in self.links():
            number, known = pd.factorize(pair)
            once = pd.unique(doc * len(known) + number)
            documents.append(once // len(known))
            keys.append(known[once % len(known)])
        if not keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(keys) == 1:
            number, known = pd.factorize(keys[0])
            return known, np.bincount(number, minlength=len(known))
        number, known = pd.factorize(np.concatenate(keys))
        once = pd.unique(np.concatenate(documents) * len(known) + number)
        return known, np.bincount(once % len(known), minlength=len(known))

    def order(self) -> np.ndarray:
        """Numbers of all tokens (those of A, then those of B) group by group, A before B."""
        n = len(self.a.ids)
        out = np.empty(n + len(self.b.ids), np.int64)
        out[np.arange(n) + self.first_b[self.group_a]] = np.arange(n)
        out[np.arange(len(self.b.ids)) + (self.first_a + self.size_a)[self.group_b]] = np.arange(n, len(out))
        return out

    @staticmethod
    def last(groups: np.ndarray) -> np.ndarray:
        """1 for the last token of every group."""
        out = np.ones(len(groups), np.int64)
        out[:-1] = groups[1:] != groups[:-1]
        return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


class Both:
    """The two tokenizers of a worker."""

    def __init__(self, ranks: str, model: str) -> None:
        self.a, self.b = codec(ranks), pieces(model)
        self.width_a, self.width_b = (np.array([len(t) for t in side.bytes_of], np.int64) for side in (self.a, self.b))
        # Ids with the mark behind them: "," between ids of one kind, "|" after A's, ";" after B's.
        self.spelled_a = np.array([f"{i}{mark}" for i in range(len(self.width_a)) for mark in ",|"], "S")
        self.spelled_b = np.array([f"{i}{mark}" for i in range(len(self.width_b)) for mark in ",;"], "S")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return _NO_IDS, _NO_IDS
        spelled, out = f" {text}".encode(), []
        for ids, side in ((self.a.plain(f" {text}"), self.a), (self.b.plain(text), self.b)):
            if b"".join(map(side.bytes_of.__getitem__, ids)) != spelled:
                return _NO_IDS, _NO_IDS
            out.append(np.frombuffer(array("I", ids), np.uint32))
        return out[0], out[1]

    def side_a(self, ids: np.ndarray, counts: np.ndarray) -> Side:
        return Side(ids, counts, self.width_a[ids])

    def side_b(self, ids: np.ndarray, counts: np.ndarray) -> Side:
        return Side(ids, counts, self.width_b[ids])

    def digests(self, aligned: Aligned) -> list[str]:
        order, n = aligned.order(), len(aligned.a.ids)
        of_a = self.spelled_a[2 * aligned.a.ids + aligned.last(aligned.group_a)]
        of_b = self.spelled_b[2 * aligned.b.ids + aligned.last(aligned.group_b)]
        spelled, out, at = np.concatenate([of_a, of_b])[order], [], 0
        for size in (aligned.a.counts + aligned.b.counts).tolist():
            digits = spelled[at : at + size].tobytes().translate(None, b"\0")[:-1]
            out.append(hashlib.sha256(digits).hexdigest() if size else "")
            at += size
        return out


@lru_cache(maxsize=2)
def both(ranks: str, model: str) -> Both:
    return Both(ranks, model)


_DOC = ["n_a", "n_b", "n_groups", "n_links"]
BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "digests array<string>, a binary, b binary, pairs array<struct<bucket: int, keys: binary, counts: binary>>"
)
_PAIRS = pa.list_(pa.struct([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))
_LONGS = pa.list_(pa.int64())
_BLOCK_TYPES = pa.schema(
    [
        ("block", pa.int64()),
        *[(name, _LONGS) for name in ("doc_ids", *_DOC)],
        ("digests", pa.list_(pa.string())),
        ("a", pa.binary()),
        ("b", pa.binary()),
        ("pairs", _PAIRS),
    ]
)


def _packed(ids: np.ndarray) -> bytes:
    """Compressed ids behind the bytes of each: repeats of words and passages are found."""
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(ids.astype(f"<u{width}").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _zipped(values: np.ndarray) -> bytes:
    """Counts, or the steps between rising keys, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unzipped(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unzipped(data, "<u8"), dtype=np.uint64)


def _steps(keys: np.ndarray) -> bytes:
    return _zipped(np.diff(keys, prepend=np.uint64(0)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the A id alone."""
    return (_mixed(keys >> np.uint64(32), 0) % np.uint64(buckets)).astype(np.int64)


def _block_row(own: Both, block: int, held: list[tuple], buckets: int) -> pa.RecordBatch:
    ids = [np.concatenate([row[side] for row in held]).astype(np.int64) for side in (1, 2)]
    counts = [np.array([len(row[side]) for row in held], np.int64) for side in (1, 2)]
    aligned = Aligned(own.side_a(ids[0], counts[0]), own.side_b(ids[1], counts[1]))
    keys, documents = aligned.counted()
    bucket = bucket_of(keys, buckets)
    order = np.lexsort((keys, bucket))
    keys, documents, bucket = keys[order], documents[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    parts = [
        {"bucket": k, "keys": _steps(keys[low:high]), "counts": _zipped(documents[low:high].astype("<u4"))}
        for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))
        if low < high
    ]
    row = {
        "block": block,
        "doc_ids": [row[0] for row in held],
        "n_a": counts[0],
        "n_b": counts[1],
        "n_groups": aligned.per_document(),
        "n_links": aligned.per_document(aligned.size_a * aligned.size_b),
        "digests": own.digests(aligned),
        "a": _packed(ids[0]),
        "b": _packed(ids[1]),
        "pairs": parts,
    }
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _BLOCK_TYPES], schema=_BLOCK_TYPES)


def blocks(docs: DataFrame, ranks: str, model: str, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """First pass: documents aligned in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = both(ranks, model), [], 0
        number = TaskContext.get().partitionId() << TASK_SHIFT
        for batch in batches:
            for doc_id, text in texts(batch):
                held.append((doc_id, *own.tokens(text)))
                size += len(text) + 1
                if size >= block:
                    yield _block_row(own, number, held, buckets)
                    held, size, number = [], 0, number + 1
        if held:
            yield _block_row(own, number, held, buckets)

    return slim(docs).mapInArrow(run, BLOCKS)


def _joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _node_row(key: tuple, name: str, value: bytes) -> pa.Table:
    bucket, node = (part.as_py() for part in key)
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "node": pa.array([node], pa.int64()), name: pa.array([value])})


def _combined(rows: DataFrame, name: str, combine: Callable[[pa.Table], bytes]) -> DataFrame:
    """(bucket, node, ``name``): the values of every node made one."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        return _node_row(key, name, combine(table))

    return rows.groupBy("bucket", "node").applyInArrow(join, f"bucket int, node long, {name} binary")


def _summed(rows: DataFrame, name: str, combine: Callable[[pa.Table], bytes], leaves: int, fan: int) -> DataFrame:
    """(bucket, ``name``): the leaves combined up a tree, ``fan`` nodes at a time."""
    while leaves > 1:
        leaves = -(-leaves // fan)
        rows = _combined(rows.withColumn("node", F.expr(f"node div {fan}")), name, combine)
    return rows.select("bucket", name)


def _rows_of(parts: DataFrame, leaves: int) -> DataFrame:
    """(block, bucket, node, keys, counts): the pairs of every block, leaves of some ``FAN`` blocks."""
    node = F.pmod(F.xxhash64("block"), F.lit(leaves)).alias("node")
    return parts.select("block", node, F.inline("pairs"))


def tables(parts: DataFrame, n_blocks: int, fan: int = FAN) -> DataFrame:
    """(bucket, hash, keys, counts, best): the verified count table of every bucket."""
    leaves = max(1, -(-n_blocks // fan))
    rows = _rows_of(parts, leaves)

    def united(table: pa.Table) -> bytes:
        return _steps(np.unique(_joined(list(map(_keys, table.column("keys").to_pylist())), "<u8")))

    distinct = _summed(_combined(rows.select("bucket", "node", "keys"), "keys", united), "keys", united, leaves, fan)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = _keys(data)
                found = PerfectHash.of(keys)
                placed = np.empty_like(keys)
                placed[found.index(keys)] = keys
                row = [pa.array([bucket], pa.int32()), pa.array([found.dump()], pa.binary()), pa.array([placed.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["bucket", "hash", "keys"])

    hashes = written(distinct.mapInArrow(hashed, "bucket int, hash binary, keys binary"), "pair-hashes")

    def dense(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        index = PerfectHash.load(own.column("hash")[0].as_py())
        vector = np.zeros(index.size, np.int64)
        for keys, counts in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            # The keys of one block are distinct.
            vector[index.index(_keys(keys))] += _unzipped(counts, "<u4")
        return _node_row(key, "vector", vector.tobytes())

    def added(table: pa.Table) -> bytes:
        total = 0
        for vector in table.column("vector").to_pylist():
            total = total + np.frombuffer(vector, np.int64)
        return total.tobytes()

    met = rows.select("bucket", "node", "keys", "counts").groupBy("bucket", "node").cogroup(
        _at_leaves(hashes.select("bucket", "hash"), leaves).groupBy("bucket", "node")
    )
    vectors = met.applyInArrow(_where_rows(dense, _VECTOR), "bucket int, node long, vector binary")
    totals = _summed(vectors, "vector", added, leaves, fan)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, hash_, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, known = pd.factorize(np.frombuffer(keys, "<u8") >> np.uint64(32))
                count = np.frombuffer(counts, np.int64)
                most = np.zeros(len(known), np.int64)
                np.maximum.at(most, number, count)
                best = (count == most[number]).astype(np.uint8).tobytes()
                row = [pa.array([bucket], pa.int32()), *(pa.array([v], pa.binary()) for v in (hash_, keys, counts, best))]
                yield pa.RecordBatch.from_arrays(row, ["bucket", "hash", "keys", "counts", "best"])

    whole = hashes.join(totals, "bucket").select("bucket", "hash", "keys", "vector")
    return written(whole.mapInArrow(ranked, "bucket int, hash binary, keys binary, counts binary, best binary"), "pair-counts")


_VECTOR = pa.schema([("bucket", pa.int32()), ("node", pa.int64()), ("vector", pa.binary())])


def _at_leaves(per_bucket: DataFrame, leaves: int) -> DataFrame:
    return per_bucket.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))).alias("node"))


def _where_rows(make: Callable[[tuple, pa.Table, pa.Table], pa.Table], empty: pa.Schema):
    """A leaf without blocks has nothing to add."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return make(key, left, right) if left.num_rows else empty.empty_table()

    return run


_ANSWERS = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def answers(parts: DataFrame, counted: DataFrame, n_blocks: int, fan: int = FAN) -> DataFrame:
    """(block, keys, counts, best) of the distinct pairs of every block and bucket."""
    leaves = max(1, -(-n_blocks // fan))

    def look_up(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        hash_, known, counts, best = (own.column(c)[0].as_py() for c in ("hash", "keys", "counts", "best"))
        index, known = PerfectHash.load(hash_), np.frombuffer(known, "<u8")
        counts, best = np.frombuffer(counts, np.int64), np.frombuffer(best, np.uint8)
        out = []
        for data in table.column("keys").to_pylist():
            keys = _keys(data)
            at = index.index(keys)
            if not np.array_equal(known[at], keys):
                raise ValueError("a pair is not in the count table")
            out.append((_zipped(counts[at]), _zipped(np.packbits(best[at]))))
        columns = [table.column("block"), table.column("keys"), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))]
        return pa.Table.from_arrays(columns, schema=_ANSWERS)

    asked = _rows_of(parts, leaves).select("bucket", "node", "block", "keys").groupBy("bucket", "node")
    met = asked.cogroup(_at_leaves(counted, leaves).groupBy("bucket", "node"))
    return met.applyInArrow(_where_rows(look_up, _ANSWERS), "block long, keys binary, counts binary, best binary")


_NAMES = ["doc_id", *_DOC, "n_best", "count_sum", "groups_sha256"]
SCHEMA = ", ".join(f"{name} {'string' if name == 'groups_sha256' else 'long'}" for name in _NAMES)


def report(
    docs: DataFrame,
    ranks: str | None = None,
    model: str | None = None,
    block: int = BLOCK,
    buckets: int = BUCKETS,
    fan: int = FAN,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    ranks, model = ranks or public_tokenizers.path(RANKS_A), model or public_tokenizers.path(MODEL_B)
    parts = written(blocks(docs, ranks, model, block, buckets), "aligned-blocks")
    n_blocks = parts.count()
    counted = tables(parts, n_blocks, fan)

    def again(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        tokenizers = both(ranks, model)
        n_a, n_b = (np.array(row[c], np.int64) for c in ("n_a", "n_b"))
        sides = (tokenizers.side_a(_unpacked(row["a"]), n_a), tokenizers.side_b(_unpacked(row["b"]), n_b))
        parts = [(_keys(k), _unzipped(c, "<i8"), _unzipped(b, "u1")) for k, c, b in zip(*(c.to_pylist() for c in found.columns[1:]), strict=True)]
        keys, counts = _joined([k for k, _, _ in parts], "<u8"), _joined([c for _, c, _ in parts], "<i8")
        best = _joined([np.unpackbits(b, count=len(k)) for k, _, b in parts], "u1").astype(np.int64)
        order = np.argsort(keys)
        keys, counts, best = keys[order], counts[order], best[order]
        n_best, count_sum = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64)
        for doc, pair, times in Aligned(*sides).links():
            number, known = pd.factorize(pair)
            at = np.searchsorted(keys, known)[number]
            np.add.at(n_best, doc, times * best[at])
            np.add.at(count_sum, doc, times * counts[at])
        columns = [row["doc_ids"], *(row[c] for c in _DOC), n_best, count_sum]
        arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array(row["digests"], pa.string())]
        return pa.Table.from_arrays(arrays, names=_NAMES)

    own = parts.drop("pairs").groupBy("block")
    return own.cogroup(answers(parts, counted, n_blocks, fan).groupBy("block")).applyInArrow(again, SCHEMA)


def pair_counts(docs: DataFrame, ranks: str | None = None, model: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """a_id, b_id, documents that hold the pair linked, and whether it is among the best of its A id."""
    ranks, model = ranks or public_tokenizers.path(RANKS_A), model or public_tokenizers.path(MODEL_B)
    parts = written(blocks(docs, ranks, model, buckets=buckets), "aligned-blocks")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], "<u8")
                columns = [keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), np.frombuffer(row["counts"], np.int64)]
                arrays = [pa.array(c.astype(np.int64)) for c in columns]
                best = pa.array(np.frombuffer(row["best"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([*arrays, best], ["a_id", "b_id", "documents", "is_best"])

    counted = tables(parts, parts.count()).select("keys", "counts", "best")
    return counted.mapInArrow(spread, "a_id long, b_id long, documents long, is_best boolean")


def groups(docs: DataFrame, ranks: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id and its groups, the ids of A and of B in each."""
    ranks, model = ranks or public_tokenizers.path(RANKS_A), model or public_tokenizers.path(MODEL_B)
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = both(ranks, model)
        for batch in batches:
            for doc_id, text in texts(batch):
                a, b = (ids.astype(np.int64) for ids in own.tokens(text))
                one = Aligned(own.side_a(a, np.array([len(a)])), own.side_b(b, np.array([len(b)])))
                cut_a, cut_b = np.split(a, one.first_a[1:]), np.split(b, one.first_b[1:])
                found = [{"a": x.tolist(), "b": y.tolist()} for x, y in zip(cut_a, cut_b, strict=True)] if len(a) else []
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([found], kind)], ["doc_id", "groups"])

    return slim(docs).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
