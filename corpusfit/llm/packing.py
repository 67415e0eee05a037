"""Packing of tokenized examples into training sequences under several limits at once.

A sequence has limits on tokens, on segments and on loss-bearing tokens. Each task keeps a buffer of waiting
pieces and fills one sequence at a time: of the pieces that fit, the one whose demand has the largest dot
product with what is left of the limits goes in. When nothing fits whole, a piece is cut to fill the
gap, so sequences end full; one that a limit other than tokens closes early is cut back to a power of two,
which needs no padding. Nothing is shuffled and no state is shared between tasks: each fills up its last sequences
with the same cuts.

Defined cases: a null or empty text is the end id alone; a null document id stays null; repeated rows are
packed once per row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.llm import word_tokens

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long, segment long"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
ROWS_AT_ONCE = 5_000


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass(frozen=True)
class Piece:
    """``ids[start:]`` of a document still to be placed; ids before ``quiet`` bear no loss."""

    doc_id: int | None
    ids: bytes
    start: int
    doc_tokens: int
    quiet: int

    @property
    def length(self) -> int:
        return len(self.ids) // word_tokens.ID_BYTES

    def loss(self, length: int) -> int:
        end = self.start + length
        return max(0, end - max(self.start, self.quiet))

    def fitting(self, tokens: int, loss: int) -> int:
        """Longest prefix within the two limits."""
        silent = max(0, self.quiet - self.start)
        return min(self.length, tokens, silent + loss)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        at = length * word_tokens.ID_BYTES
        head = Piece(self.doc_id, self.ids[:at], self.start, self.doc_tokens, self.quiet)
        return head, Piece(self.doc_id, self.ids[at:], self.start + length, self.doc_tokens, self.quiet)


def _needs(piece: Piece) -> tuple[int, int, int, int]:
    return piece.length, 1, piece.loss(piece.length), max(0, piece.quiet - piece.start)


class Packer:
    """Fills sequences from a bounded buffer of pieces."""

    def __init__(self, limits: Limits, first_sequence: int, waiting: int = 256):
        self.limits, self.sequence, self.room = limits, first_sequence, waiting
        self.pieces: list[Piece] = []
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        top = self.limits
        while (size := piece.fitting(top.tokens, top.loss)) < piece.length and size:
            if size < top.tokens:
                size = 1 << (size.bit_length() - 1)
            head, piece = piece.cut(size)
            self._emit([head])
        if piece.length:
            self.pieces.append(piece)
        if len(self.pieces) >= 2 * self.room:
            self._fill(self.room)

    def finish(self) -> None:
        self._fill(0)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def _fill(self, keep: int) -> None:
        """Close sequences until at most ``keep`` pieces wait."""
        top, waiting = self.limits, list(self.pieces)
        scale = np.array([1 / top.tokens, 1 / top.segments, 1 / top.loss])
        # Columns: tokens, segments and loss of a piece, and its leading ids without loss. A free slot has tokens 0.
        need = np.array([_needs(p) for p in waiting], float).reshape(-1, 4)
        while (need[:, 0] > 0).sum() > keep:
            chosen: list[Piece] = []
            free: list[int] = []
            left = np.array([top.tokens, top.segments, top.loss], float)
            while left[0] > 0 and left[1] > 0:
                ready = need[:, 0] > 0
                fits = ready & (need[:, 0] <= left[0]) & (need[:, 2] <= left[2])
                value = np.where(fits, need[:, :3] @ (scale * scale * left), -1.0)
                pick = int(np.argmax(value))
                piece, rest = waiting[pick], None
                if value[pick] < 0:
                    sizes = np.where(ready, np.minimum(np.minimum(need[:, 0], left[0]), need[:, 3] + left[2]), 0)
                    pick = int(np.argmax(sizes))
                    if sizes[pick] <= 0:
                        break
                    piece, rest = waiting[pick].cut(int(sizes[pick]))
                chosen.append(piece)
                left -= _needs(piece)[:3]
                if rest is None:
                    need[pick, 0] = 0
                    free.append(pick)
                else:
                    waiting[pick], need[pick] = rest, _needs(rest)
            for piece in self._to_power_of_two(chosen, top.tokens - int(left[0])):
                if free:
                    slot = free.pop()
                    waiting[slot], need[slot] = piece, _needs(piece)
                else:
                    waiting.append(piece)
                    need = np.vstack([need, _needs(piece)])
            self._emit(chosen)
        self.pieces = [waiting[k] for k in np.flatnonzero(need[:, 0] > 0)]

    def _to_power_of_two(self, chosen: list[Piece], filled: int) -> list[Piece]:
        """Cut the end of a sequence that is not full, so that it needs no padding; gives what was cut off."""
        if filled == self.limits.tokens:
            return []
        excess, back = filled - (1 << (filled.bit_length() - 1)), []
        while excess:
            piece = chosen.pop()
            if piece.length > excess:
                head, tail = piece.cut(piece.length - excess)
                chosen.append(head)
                back.append(tail)
                break
            back.append(piece)
            excess -= piece.length
        return back

    def _emit(self, chosen: list[Piece]) -> None:
        offset = 0
        for segment, p in enumerate(chosen):
            self.rows.append((
                p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, self.sequence, offset,
                p.loss(p.length), segment))
            offset += p.length
        self.sequence += 1


def pack(
    docs: DataFrame, vocabulary: str | None = None, limits: Limits = Limits(), end_id: int = 1, quiet: str | None = None
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    ``quiet`` names a column with the number of leading ids that bear no loss (a prompt); without it, that is the
    first id, which nothing precedes.
    """
    path = vocabulary or word_tokens.vocabulary()
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([(n, pa.int64()) for n in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens.shared(path)
        packer = Packer(limits, TaskContext.get().partitionId() << 32)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.take())) or [()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            doc_ids, silent = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for k, ids in enumerate(encoder.encode(batch.column(1))):
                own = ids.tobytes() + end
                packer.add(Piece(doc_ids[k], own, 0, len(own) // word_tokens.ID_BYTES, silent[k] or 0))
                if len(packer.rows) >= ROWS_AT_ONCE:
                    yield out()
        packer.finish()
        yield out()

    silent = F.col(quiet).cast("long") if quiet else F.lit(1).cast("long")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), silent.alias("quiet"))
    return columns.mapInArrow(run, SCHEMA)
