"""Packing documents into windows of a fixed number of tokens, in bounded space.

Each partition reads its documents once and keeps a fixed number of windows
open.  A document's full windows leave at once; its rest goes into the open
window that it fills best.  Where none has room and no more may be opened, the
fullest one leaves: topped up with the head of the rest, if its gap is worth a
cut, else padded.  At the end the windows still open in a group of partitions
are merged by filling new windows with their pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare, stored, tidied
from .tokens import read_vocabulary, tokenizer

#: Windows a partition holds open; the least gap that a document is cut for; partitions merged at the end.
OPEN_WINDOWS, LEAST_CUT, MERGED_PARTITIONS = 64, 16, 64

_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_FIRST = pa.schema([*_FIELDS, ("part", pa.int32()), ("slot", pa.int32())])
_DDL = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, bytes, int]  # doc_id, start, ids, doc_tokens


class Packer:
    """Open windows; ``closed`` gathers the windows that left, as lists of pieces."""

    def __init__(self, window: int, open_windows: int, least_cut: int):
        self.window, self.limit, self.least_cut = window, open_windows, least_cut
        self.rooms: list[tuple[int, int]] = []  # sorted: room left, number of the window
        self.open: dict[int, list[Piece]] = {}
        self.closed: list[list[Piece]] = []
        self.count = 0

    def add(self, doc: int, ids: bytes, total: int, start: int = 0) -> None:
        """Place ``ids`` (4 bytes each), which begin at token ``start`` of a document of ``total`` tokens."""
        at, n = 0, len(ids) // 4
        while n - at >= self.window:
            self.closed.append([(doc, start + at, ids[4 * at : 4 * (at + self.window)], total)])
            at += self.window
        while at < n:
            rest = n - at
            i = bisect_left(self.rooms, (rest, -1))
            if i == len(self.rooms) and len(self.rooms) < self.limit:
                self.count += 1
                self.open[self.count] = []
                insort(self.rooms, (self.window, self.count))
                i = bisect_left(self.rooms, (rest, -1))
            if i == len(self.rooms):
                i = 0  # none has room: the fullest leaves
                if self.rooms[0][0] < self.least_cut:
                    self.closed.append(self.open.pop(self.rooms.pop(0)[1]))
                    continue
            room, w = self.rooms.pop(i)
            put = min(room, rest)
            self.open[w].append((doc, start + at, ids[4 * at : 4 * (at + put)], total))
            at += put
            if room > put:
                insort(self.rooms, (room - put, w))
            else:
                self.closed.append(self.open.pop(w))


def _rows(windows: list[list[Piece]], first_id: int | None, with_ids: bool) -> list[tuple]:
    """``first_id`` None: windows that are still open, whose ids are needed for merging."""
    out = []
    for k, pieces in enumerate(windows):
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, ids if with_ids or first_id is None else None, crc32(ids), total,
                        None if first_id is None else first_id + k, offset))
            offset += n
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, vocabulary_path: str, window: int = 2048, end_id: int = 1, open_windows: int = OPEN_WINDOWS,
         least_cut: int = LEAST_CUT, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit integers (null unless ``with_ids``); every
    document ends with ``end_id``, which also is all that a null or empty text has.
    Sequences hold at most ``window`` tokens; their ids are unique, not gapless.
    Repeated rows are packed each; an empty table gives no rows; texts of any length
    are read whole and cut into windows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder, packer, done = tokenizer(vocabulary.value), Packer(window, open_windows, least_cut), 0
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), coder.encode([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]), strict=True):
                packer.add(doc, ids + end, len(ids) // 4 + 1)
            rows = _rows(packer.closed, (part << 32) + done, with_ids)
            done += len(packer.closed)
            packer.closed.clear()
            yield _batch([(*r, part, None) for r in rows], _FIRST)
        rest = [(*r, part, w) for w, pieces in packer.open.items() for r in _rows([pieces], None, True)]
        yield _batch(rest, _FIRST)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        """The fullest windows stay; the pieces of the others fill new windows to the brim."""
        g = group.sort_by([("part", "ascending"), ("slot", "ascending"), ("offset", "ascending")]).to_pylist()
        windows: dict[tuple, list[Piece]] = {}
        for r in g:
            windows.setdefault((r["part"], r["slot"]), []).append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        packer = Packer(window, 1, 1)
        for pieces in windows.values():
            if window - least_cut < sum(len(p[2]) // 4 for p in pieces):
                packer.closed.append(pieces)
            else:
                for doc, start, ids, total in pieces:
                    packer.add(doc, ids, total, start)
        rows = _rows(packer.closed + list(packer.open.values()), (1 << 62) + (key[0].as_py() << 32), with_ids)
        return pa.Table.from_batches([_batch(rows, _FIELDS)])

    pieces = stored(pick(docs, doc_id=id_col, text=text_col).mapInArrow(tidied(first), f"{_DDL}, part int, slot int"), "pieces")
    names = [f.name for f in _FIELDS]
    left = pieces.filter(F.col("sequence_id").isNull()).withColumn("group", F.floor(F.col("part") / MERGED_PARTITIONS).cast("long"))
    return pieces.filter(F.col("sequence_id").isNotNull()).select(names).unionByName(
        left.groupBy("group").applyInArrow(merge, _DDL))
