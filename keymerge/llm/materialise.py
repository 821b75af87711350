"""Training order as files: every sequence at a slot given by a keyed permutation.

Documents are coded and strung together per input partition, and cut into sequences of
equal length.  A first pass in the JVM adds up bytes, of which a token has one at least, so
that every partition has a range of numbers for its sequences before anything is coded.  A
Feistel network keyed by the epoch's key permutes these numbers: it permutes a range of
``4 ** k`` numbers, and numbers beyond the last are sent through again until they fall inside
(cycle-walking).  So each sequence knows its place without any table.  Each range of
places is one task, which writes its sequences in order into one shard of fixed-stride records;
the numbers that no sequence has leave no gaps.  A sequence's slot is the number of records in the
shards before its own and in its own before it, so reading can go on from any slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_scratch
from .common import pick, prepare, stored, tidied
from .tokens import byte_tokenizer

#: Tokens of a sequence, sequences of a shard (16 MB) if a token has ``TOKEN_BYTES`` bytes on average, and rounds of the network.
LENGTH, PER_SHARD, TOKEN_BYTES, ROUNDS = 2048, 4096, 4, 6


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of ``range(size)``."""

    size: int
    key: int

    @property
    def _half(self) -> int:
        return max(1, (max(self.size - 1, 1).bit_length() + 1) // 2)

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = x + np.uint64((self.key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self._half) - 1)

    def _network(self, x: np.ndarray, rounds: range) -> np.ndarray:
        bits, mask = np.uint64(self._half), np.uint64((1 << self._half) - 1)
        left, right = x >> bits, x & mask
        for r in rounds:
            if rounds.step > 0:
                left, right = right, left ^ self._round(right, r)
            else:
                left, right = right ^ self._round(left, r), left
        return (left << bits) | right

    def _walk(self, x: np.ndarray, rounds: range) -> np.ndarray:
        out = self._network(np.asarray(x, np.uint64), rounds)
        while (outside := out >= self.size).any():
            out[outside] = self._network(out[outside], rounds)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, range(ROUNDS))

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, range(ROUNDS - 1, -1, -1))


def _sequences(batches: Iterator[pa.RecordBatch], vocabulary: tuple[bytes, str], end: bytes, length: int) -> Iterator[list[tuple]]:
    """Per batch the full sequences ``(ids, tokens, first doc, its start)``; at last the rest, if any."""
    coder = byte_tokenizer(*vocabulary)
    held, doc, start = b"", None, 0  # ids not given out yet, and where they begin
    for b in batches:
        out = []
        for d, coded in zip(b.column(0).to_pylist(), coder.encode([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]), strict=True):
            ids = coded + end
            begin = -len(held) // 2  # of this document, before the token next given out
            if not held:
                doc, start, begin = d, 0, 0
            held += ids
            at = 0
            while len(held) - at >= 2 * length:
                out.append((held[at : at + 2 * length], length, doc, start))
                at += 2 * length
                doc, start = d, begin + at // 2
            held = held[at:]
        yield out
    if held:
        yield [(held, len(held) // 2, doc, start)]


def write_training_order(docs: DataFrame, ranks_path: str, pattern: str, folder: str, key: int = 0, length: int = LENGTH,
                         per_shard: int = PER_SHARD, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards into ``folder`` (new, and shared by all executors) and return the manifest:
    ``slot, shard, byte_offset, number, first_doc_id, first_start, length, ids_crc32``, one row per sequence.

    A record is ``length`` ids as little-endian unsigned 16-bit integers, the last sequence
    of an input partition padded with ``end_id``; ``length`` in the manifest leaves the
    padding out.  ``slot`` is gapless from 0; ``number`` follows the order of the input, with gaps.  A
    shard is a range of places and holds about ``per_shard`` sequences if a token has ``TOKEN_BYTES``
    bytes, fewer if it has more; empty shards have no file.  Every document ends with ``end_id``,
    which also is all that a null or empty text has; repeated rows are written each; an empty table
    gives neither rows nor files; other columns are ignored.  Texts are coded once.  A file
    appears under its name only when it is whole, and a task that runs again writes the same bytes.

    ``docs`` must give the same partitions each time, as a scan of files does; if one holds
    more than was counted, the job fails.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(ranks_path, "rb") as f:  # a vocabulary, of fixed size
        vocabulary = spark.sparkContext.broadcast((f.read(), pattern))
    end = end_id.to_bytes(2, "little")
    rows = pick(docs, doc_id=id_col, text=text_col)
    # One small row per input partition.
    most = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    counts = rows.groupBy(F.spark_partition_id().alias("part")).agg(most.alias("n")).toArrow().to_pydict()
    first, total = {}, 0
    for part, n in sorted(zip(counts["part"], counts["n"], strict=True)):
        first[part] = total, -(-n // length)
        total += first[part][1]
    before, permutation = spark.sparkContext.broadcast(first), Permutation(total, key)
    width = per_shard * TOKEN_BYTES  # places of a shard

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, room = before.value.get(TaskContext.get().partitionId(), (0, 0))
        done = 0
        for found in _sequences(batches, vocabulary.value, end, length):
            number = np.arange(at + done, at + done + len(found))
            done += len(found)
            if done > room:
                raise RuntimeError("the input's partitions changed between two reads")
            ids, n, doc, start = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(permutation.slot(number)), pa.array(number), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["place", "number", "first_doc_id", "first_start", "length", "ids"])

    stride = 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        stream, temp, shard, name, row = None, "", -1, "", 0

        def close() -> None:
            if stream is not None:
                stream.close()
                fs.move(temp, name)

        for b in batches:
            shards, at, sums = [], [], []
            for p, n, ids in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if p // width != shard:
                    close()
                    shard, row = p // width, 0
                    name = _shard_name(root, shard)
                    temp = f"{name}.{uuid4().hex}.part"
                    stream = fs.open_output_stream(temp)
                stream.write(ids + end * (length - n))
                shards.append(shard)
                at.append(row * stride)
                sums.append(crc32(ids))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array(at, pa.int64()), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(sums, pa.int64())],
                ["shard", "byte_offset", "number", "first_doc_id", "first_start", "length", "ids_crc32"])
        close()

    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    dealt = (rows.mapInArrow(tidied(place), "place long, number long, first_doc_id long, first_start long, length long, ids binary")
             .repartitionById(max(1, -(-total // width)), F.floor(F.col("place") / width).cast("int"))
             .sortWithinPartitions("place"))
    manifest = stored(dealt.mapInArrow(write, "shard long, byte_offset long, number long, first_doc_id long, first_start long, length long, ids_crc32 long"), "manifest")
    # One row per shard.
    sizes = manifest.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    starts = stored(sizes.withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "before"), "starts")
    slot = (F.col("before") + F.col("byte_offset") / stride).cast("long")
    return manifest.join(F.broadcast(starts), "shard").select(slot.alias("slot"), *manifest.columns)


def _shard_name(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def training_folder(spark) -> str:
    """A new folder for shards, below the shared one, as a URI."""
    ensure_checkpoint_dir(spark)
    path = shared_scratch(spark, "shards")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def read_slots(folder: str, slot: int, count: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The sequences of slots ``slot`` to ``slot + count``, read one after another (to resume at a slot, begin there).

    The sizes of the files say which slots a shard holds.
    """
    fs, root = FileSystem.from_uri(folder)
    stride, last, before = 2 * length, slot + count, 0
    for info in sorted((f for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".bin")), key=lambda f: f.path):
        held = info.size // stride
        if slot < min(last, before + held):
            with fs.open_input_file(info.path) as f:
                f.seek((slot - before) * stride)
                while slot < min(last, before + held):
                    yield np.frombuffer(f.read(stride), "<u2")
                    slot += 1
        before += held
