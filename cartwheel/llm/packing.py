"""Hierarchical multi-length packing.

Documents are turned into ids, closed by id 0 and routed to the smallest context
size that holds them; of longer ones every full longest window stands alone and
the rest is routed. Each tier is packed longest document first. A gap in a window
is filled with the longest documents of the shorter tiers that fit, and the last
of it with a cut of a short one, so windows are full. What is left over when a
block ends waits for the next one. At the end of a partition the last windows
take the context sizes that fill them; at most one sequence there is padded.
Sequences of one context size are dealt to step groups of one token budget, in
turns by attention cost, so that the steps are alike.

Ids are those of byte_bpe_50k.json: an added token of it that stands in a text is
one id, and the parts between are encoded on their own.

Every task packs its own rows and holds one block of ids, nothing is shuffled.
Null text counts as empty: its document is the closing id alone. Equal rows are
packed as often as they come, an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cartwheel.llm.bpe import Codec, codec
from cartwheel.llm.rows import slim, texts

#: The ranks of the vocabulary in byte_bpe_50k.json.
RANKS = "byte_bpe_50k.tiktoken"
#: Names the added tokens.
TOKENIZER = "byte_bpe_50k.json"
TIERS = (64, 128, 256, 512, 1024)
STEP_TOKENS = 8192
BLOCK_TOKENS = 1 << 20
CLOSING_ID = 0
TASK_SHIFT = 40

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)
_KINDS = (*[pa.int64()] * 7, pa.int32(), pa.int64())
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]

# A piece: (length, number of its document in the task, start in that document).
Piece = tuple[int, int, int]


def added_tokens(path: str) -> dict[str, int]:
    """Text -> id of the tokens that are matched in texts before all others."""
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def with_added(own: Codec, added: dict[str, int], text: str) -> list[int]:
    """Ids of a text; no window of the codec crosses an added token."""
    if not any(token in text for token in added):
        return own.encode(text)
    ids: list[int] = []
    # The longest first, as they are matched.
    for part in re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text):
        if part in added:
            ids.append(added[part])
        elif part:
            ids += own.encode(part)
    return ids


class Packer:
    """Packs the pieces of one task block by block."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.step_tokens = step_tokens
        self.waiting: list[list[Piece]] = [[] for _ in self.tiers]
        self.full: list[tuple[int, list[Piece]]] = []

    def route(self, piece: Piece) -> None:
        insort(self.waiting[bisect_left(self.tiers, piece[0])], piece)

    def add(self, document: int, length: int) -> None:
        window = self.tiers[-1]
        whole = length - length % window
        self.full += [(window, [(window, document, at)]) for at in range(0, whole, window)]
        if length > whole:
            self.route((length - whole, document, whole))

    def _fill(self, tier: int, row: list[Piece], gap: int) -> int:
        """Put the longest waiting pieces of at most this tier into the gap; the last one is cut."""
        for below in range(tier, -1, -1):
            pieces = self.waiting[below]
            while gap and (at := bisect_right(pieces, (gap, 1 << 62, 0))):
                row.append(pieces.pop(at - 1))
                gap -= row[-1][0]
        for below in range(tier + 1):
            if gap and self.waiting[below]:
                length, document, start = self.waiting[below].pop(0)
                row.append((gap, document, start))
                self.route((length - gap, document, start + gap))
                gap = 0
        return gap

    def pack(self, last: bool) -> list[tuple[int, list[Piece]]]:
        """The full sequences so far; with ``last`` also those of the rest."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.waiting[tier]:
                row = [self.waiting[tier].pop()]
                if gap := self._fill(tier, row, size - row[0][0]):
                    self._leave(row, size - gap, last)
                    break
                self.full.append((size, row))
        done, self.full = self.full, []
        return done

    def _leave(self, row: list[Piece], length: int, last: bool) -> None:
        """All that was waiting up to this tier is in ``row``: too little for a window."""
        if not last:
            for piece in row:
                self.route(piece)
            return
        for size in reversed(self.tiers):
            while length >= size:
                taken, need = [], size
                while need:
                    part, document, start = row.pop()
                    if part > need:
                        row.append((part - need, document, start + need))
                    taken.append((min(part, need), document, start))
                    need -= min(part, need)
                self.full.append((size, taken))
                length -= size
        if row:
            self.full.append((self.tiers[-1], row))

    def steps(self, sequences: list[tuple[int, list[Piece]]]) -> list[int]:
        """Number of the step group of each sequence: equal tokens, and cost dealt in turns."""
        out = [0] * len(sequences)
        first = 0
        for size in self.tiers:
            own = [i for i, (tier, _) in enumerate(sequences) if tier == size]
            own.sort(key=lambda i: (-sum(p[0] * p[0] for p in sequences[i][1]), i))
            groups = -(-len(own) * size // self.step_tokens)
            for turn, i in enumerate(own):
                lap, at = divmod(turn, groups)
                out[i] = first + (at if lap % 2 == 0 else groups - 1 - at)
            first += groups
        return out


def pack(
    docs: DataFrame,
    path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: where it is in its document and in its sequence."""
    path = path or public_tokenizers.path(RANKS)
    added = added_tokens(public_tokenizers.path(TOKENIZER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        packer = Packer(tiers, step_tokens)
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << TASK_SHIFT
        counts = [0, 0]

        def ready(last: bool) -> pa.RecordBatch:
            sequences = packer.pack(last)
            groups = packer.steps(sequences)
            out: list[list] = [[] for _ in _NAMES]
            for (tier, row), group in zip(sequences, groups, strict=True):
                offset = 0
                for length, number, start in row:
                    doc_id, ids = held[number]
                    crc = zlib.crc32(ids[start : start + length])
                    values = (doc_id, start, length, crc, len(ids), base + counts[0], offset, tier, base + counts[1] + group)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    offset += length
                counts[0] += 1
            counts[1] += max(groups, default=-1) + 1
            waiting = {piece[1] for tier in packer.waiting for piece in tier}
            for number in [n for n in held if n not in waiting]:
                del held[number]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _KINDS, strict=True)], _NAMES)

        tokens = 0
        rows = (row for batch in batches for row in texts(batch))
        for number, (doc_id, text) in enumerate(rows):
            ids = np.asarray([*with_added(own, added, text), CLOSING_ID], dtype="<u4")
            held[number] = (doc_id, ids)
            packer.add(number, len(ids))
            tokens += len(ids)
            if tokens >= block_tokens:
                tokens = 0
                yield ready(False)
        yield ready(True)

    return slim(docs).mapInArrow(run, SCHEMA)
