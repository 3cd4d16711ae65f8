"""Packing token ids into sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's full windows are emitted at once; its rest goes to
the open window that it fills best. When none has room, the fullest window is filled with a cut of the rest and
emitted, and a new one opens. What is open at a partition's end is left over; leftovers, which are at most
`windows` windows a partition, are merged by the same packer in rounds of fewer and fewer partitions until one task
holds a bounded number of them, packs them end to end and cuts the last into powers of two, which need no padding.

Every round is written to the shared folder before the next reads it, so a lost executor repeats only its tasks.

Defined cases: a null or empty text is the end id alone; repeated doc_ids are packed row by row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.chunk_bpe import worker_encoder
from textveil.llm.common import id_and_text, small_batches, written

#: Partitions whose leftovers one task of the next round takes.
MERGE_FAN_IN = 16

PACKED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.binary()), ("part", pa.int32()),
])
PACKED_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left binary, part int"

#: doc_id, ids of the document before this piece, the piece's ids as uint32 bytes, ids of the document.
Piece = tuple[int | None, int, memoryview, int]


class Packer:
    """The open windows of one partition. size: ids in a sequence; windows: how many stay open."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.rooms: list[tuple[int, int]] = []  # (room, window number), ascending
        self.open: dict[int, list[Piece]] = {}
        self.opened = 0
        self.full: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        doc_id, start, ids, total = piece
        whole = 4 * self.size
        while len(ids) >= whole:
            self.full.append([(doc_id, start, ids[:whole], total)])
            start, ids = start + self.size, ids[whole:]
        while len(ids):
            n = len(ids) // 4
            at = bisect.bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):  # the least room that is enough
                room, window = self.rooms.pop(at)
                self._place(window, room, (doc_id, start, ids, total))
                return
            if len(self.rooms) < self.windows:
                self.opened += 1
                self.open[self.opened] = []
                self._place(self.opened, self.size, (doc_id, start, ids, total))
                return
            room, window = self.rooms.pop(0)  # none has room: the fullest gets a cut and goes out
            self._place(window, room, (doc_id, start, ids[: 4 * room], total))
            start, ids = start + room, ids[4 * room :]

    def _place(self, window: int, room: int, piece: Piece) -> None:
        self.open[window].append(piece)
        room -= len(piece[2]) // 4
        if room:
            bisect.insort(self.rooms, (room, window))
        else:
            self.full.append(self.open.pop(window))

    def left(self) -> list[Piece]:
        pieces = [p for _, w in self.rooms for p in self.open[w]]
        self.rooms, self.open = [], {}
        return pieces

    def finish(self) -> None:
        """Pack what is left end to end; the rest of under size ids goes out as powers of two."""
        pieces = self.left()
        rest = sum(len(p[2]) // 4 for p in pieces)
        while rest:
            room = self.size if rest >= self.size else 1 << (rest.bit_length() - 1)
            rest -= room
            sequence: list[Piece] = []
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                n = min(room, len(ids) // 4)
                sequence.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc_id, start + n, ids[4 * n :], total))
                room -= n
            self.full.append(sequence)


def _pack(pieces: Iterator[Piece], size: int, windows: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    packer, rows, n = Packer(size, windows), [], 0

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED)
        rows.clear()
        return out

    def emit() -> None:
        nonlocal n
        for sequence in packer.full:
            offset = 0
            for doc_id, start, ids, total in sequence:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, level << 57 | part << 33 | n, offset, None, part))
                offset += len(ids) // 4
            n += 1
        packer.full.clear()

    for piece in pieces:
        packer.add(piece)
        emit()
        if len(rows) >= 4096:
            yield batch()
    if last:
        packer.finish()
        emit()
    else:
        rows += [(doc_id, start, len(ids) // 4, None, total, None, None, bytes(ids), part) for doc_id, start, ids, total in packer.left()]
    if rows:
        yield batch()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, windows: int = 64, leading_space: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, leading_space)

        def pieces() -> Iterator[Piece]:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = memoryview(encoder.encode(text.as_py()) + end)
                    yield doc_id, 0, ids, len(ids) // 4

        yield from _pack(pieces(), size, windows, 0, False)

    def again(level: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = ((d, s, memoryview(i), t) for b in batches for d, s, i, t in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
            yield from _pack(pieces, size, windows, level, last)

        return merge

    table = written(spark, id_and_text(docs).mapInArrow(first, PACKED_DDL), "packed-0")
    rounds, level, last = [table], 0, False
    while not last:
        level += 1
        left = rounds[-1].where("left is not null")
        parts = left.select("part").distinct().count()
        last = parts <= MERGE_FAN_IN
        merged = left.select("doc_id", "start", "left", "doc_tokens").coalesce(1 if last else -(-parts // MERGE_FAN_IN))
        rounds.append(written(spark, merged.mapInArrow(again(level, last), PACKED_DDL), f"packed-{level}"))
    packed = rounds[0]
    for more in rounds[1:]:
        packed = packed.unionByName(more)
    return packed.where("left is null").drop("left", "part")
