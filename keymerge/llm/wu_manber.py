"""Benchmark passages in texts by Wu-Manber search for many patterns at once.

Texts and benchmark items are reduced to lower-case words between single
spaces, as bytes.  Every window of consecutive item words is a pattern.  The
patterns of a length class have a *shift* per block of bytes: how far the search
may move on without missing an occurrence that ends later.  Where the shift is
zero, the hash of the block leads to the patterns that end in it, and a direct
comparison of all bytes confirms each occurrence.

The search runs along many stretches of a text buffer at a time, as array
operations; texts are never shuffled, and their words stay in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pick, prepare, stored

#: Words are runs of ASCII letters, digits and all bytes beyond ASCII; A-Z become a-z.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of benchmark texts searched for in one pass; more items go in further passes.
PASS_BYTES = 4_000_000
#: Least lengths of the classes of patterns, the longest block, and text bytes worked on together.
CLASSES, LONGEST_BLOCK, TOGETHER = (1, 6, 12, 24, 48), 16, 8_000_000
#: Bytes that one stretch of the buffer covers.
STRETCH = 2048
_SPACE, _END = 32, 10


def normalise(texts: list[bytes]) -> np.ndarray:
    """All texts as one buffer: words between single spaces, a line break between two texts."""
    raw = np.frombuffer(b" " + b" \n ".join([t.translate(_WORDS) for t in texts]) + b" ", np.uint8)
    keep = np.empty(len(raw), bool)
    keep[0] = True
    keep[1:] = (raw[1:] != _SPACE) | (raw[:-1] != _SPACE)
    return raw[keep]


def windows(item: bytes, width: int) -> list[bytes]:
    """All runs of ``width`` words, or the whole where it has fewer (none without words), between spaces."""
    words = item.translate(_WORDS).split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))]


def _hash(buffer: np.ndarray, ends: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Hash of the ``block`` bytes that end before each of ``ends``."""
    h = np.zeros(len(ends), np.uint64)
    for k in range(block, 0, -8):  # eight bytes at a time, the first ones fewer
        n = min(8, k)
        part = np.zeros((len(ends), 8), np.uint8)
        part[:, :n] = buffer[(ends - k)[:, None] + np.arange(n)]
        h = (h ^ part.view("<u8")[:, 0]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - bits)


class PatternClass:
    """Patterns of similar length: shifts by block, and the patterns by the hash of their last block."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.least = min(map(len, patterns))
        self.block = max(1, min(LONGEST_BLOCK, self.least // 2))
        self.bits = max(12, min(24, (sum(map(len, patterns))).bit_length() + 2))
        self.buffer = np.frombuffer(b"".join(patterns), np.uint8)
        self.length = np.array([len(p) for p in patterns], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.number = np.array(numbers, np.int64)
        ends = self.start + self.length
        # The last `least` bytes count: a block that ends d bytes before the pattern's end allows a shift of d.
        longest = self.least - self.block + 1
        self.shift = np.full(1 << self.bits, longest, np.uint8 if longest < 256 else np.int64)
        for d in range(longest - 1, -1, -1):
            self.shift[self._at(self.buffer, ends - d)] = d
        last = self._at(self.buffer, ends)
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _at(self, buffer: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _hash(buffer, ends, self.block, self.bits).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences in the buffer, and the numbers of the patterns there."""
        size = len(text)
        at = np.arange(self.least, size + 1, STRETCH, dtype=np.int64)  # ends of blocks
        limit = np.minimum(at + STRETCH, size + 1)
        found_at, found_bucket = [], []
        while len(at):
            h = self._at(text, at)
            move = self.shift[h].astype(np.int64)
            zero = move == 0
            if zero.any():
                found_at.append(at[zero])
                found_bucket.append(h[zero])
                move[zero] = 1
            at = at + move
            on = at < limit
            at, limit = at[on], limit[on]
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, bucket = np.concatenate(found_at), np.concatenate(found_bucket)
        return self._confirm(text, ends, bucket)

    def _confirm(self, text: np.ndarray, ends: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare every candidate with every pattern of its bucket, byte by byte; in parts, so that long buckets stay bounded."""
        sizes = (self.bucket[bucket + 1] - self.bucket[bucket]).astype(np.int64)
        starts, numbers = [], []
        cut = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + 200_000, 200_000))
        for a, b in zip(cut, np.append(cut[1:], len(ends)), strict=True):
            if a == b:
                continue
            n = sizes[a:b]
            which = np.repeat(np.arange(a, b), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = self.order[self.bucket[bucket[which]] + within]
            start = ends[which] - self.length[p]
            fits = start >= 0
            p, start = p[fits], start[fits]
            head = min(8, self.least)  # the first bytes decide most
            same = (text[start[:, None] + np.arange(head)] == self.buffer[self.start[p][:, None] + np.arange(head)]).all(axis=1)
            p, start = p[same], start[same]
            for length in np.unique(self.length[p]):
                of = np.flatnonzero(self.length[p] == length)
                step = max(1, 4_000_000 // int(length))
                for k in range(0, len(of), step):
                    i = of[k : k + step]
                    cells = np.arange(length)
                    equal = (text[start[i][:, None] + cells] == self.buffer[self.start[p[i]][:, None] + cells]).all(axis=1)
                    starts.append(start[i][equal])
                    numbers.append(self.number[p[i]][equal])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(numbers)


class Patterns:
    """The windows of some items, by classes of length."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        owners: dict[bytes, set[str]] = {}
        for name, text in items:
            for w in windows(text, width):
                owners.setdefault(w, set()).add(name)
        self.pattern = list(owners)
        self.items = [sorted(s) for s in owners.values()]
        self.length = np.array([len(p) for p in self.pattern], np.int64)
        self.classes = []
        for low, high in zip(CLASSES, (*CLASSES[1:], None), strict=True):
            some = [k for k, p in enumerate(self.pattern) if len(p) >= low and (high is None or len(p) < high)]
            if some:
                self.classes.append(PatternClass([self.pattern[k] for k in some], some))

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: its number of words, the ranges of hit words ``[first, last]`` (merged, in order), and the items found."""
        buffer = normalise(texts)
        inside = (buffer != _SPACE) & (buffer != _END)
        words = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # where words begin
        ends = np.append(np.flatnonzero(buffer == _END), len(buffer))
        until = np.searchsorted(words, ends)
        first = np.append(0, until[:-1])
        found = [c.find(buffer) for c in self.classes]
        start = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        number = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if len(start):
            low = np.searchsorted(words, start)
            high = np.searchsorted(words, start + self.length[number])  # one beyond the last word
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, high, -1)
            hit = np.cumsum(change[:-1]) > 0
            begins = hit.copy()
            begins[1:] &= ~hit[:-1]
            own = first[first < len(words)]
            begins[own] = hit[own]  # a text's spans are its own
            begin = np.flatnonzero(begins)
            text = np.searchsorted(until, begin, side="right")
            stop = np.flatnonzero(hit & np.append(~hit[1:] | begins[1:], True))
            for t, a, b in zip(text.tolist(), (begin - first[text]).tolist(), (stop - first[text]).tolist(), strict=True):
                spans[t].append((a, b))
            where = np.searchsorted(ends, start)
            for t, n in np.unique(np.stack([where, number], 1), axis=0).tolist():
                items[t].update(self.items[n])
        return until - first, spans, items


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_ADDED = "n_words long, spans array<struct<first: long, last: long>>, items array<string>"


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of word ranges, as ranges neither overlapping nor touching."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(a + b):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items in blocks of at most about ``PASS_BYTES`` of text, one item at least."""
    sized = items.withColumn("_size", F.octet_length("text"))
    count = 1
    while True:
        block = F.pmod(F.xxhash64("name", "text"), F.lit(count)).alias("block")
        total = sized.groupBy(block).agg(F.sum("_size").alias("total"), F.count(F.lit(1)).alias("n")).agg(
            F.max(F.when(F.col("n") > 1, F.col("total"))).alias("most")).first()
        if not total.most or total.most <= 2 * PASS_BYTES or count >= 1 << 20:
            return [items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k) for k in range(count)] if count > 1 else [items]
        count *= max(2, -(-total.most // (2 * PASS_BYTES)))


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``spans`` (ranges ``first`` to ``last`` of hit
    words, counted from 0, merged) and ``items`` (ids of the items found, sorted as strings).

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is
    one window.  A word inside any occurrence of a window is hit.  A null or empty text has no
    words; a null item text no windows; an item without an id is named ''; repeated rows of an
    item count once, repeated documents each; an empty table on either side gives no hits.
    Texts are searched whole.  The items are searched for in blocks of ``PASS_BYTES`` of text, so
    the driver and each task hold one block; every further block is one more pass over ``docs``.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = pick(benchmark, name=item_col, text=item_text_col).select(
        F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    blocks = _blocks(items)
    names = docs.columns
    at = names.index(text_col)
    out = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    for k, block in enumerate(blocks):
        found = block.toArrow()
        held = spark.sparkContext.broadcast(list(zip(found.column(0).to_pylist(), [t.encode() for t in found.column(1).to_pylist()], strict=True)))
        schema = out.schema if k else StructType([*out.schema.fields, *StructType.fromDDL(_ADDED).fields])
        out = out.mapInArrow(_search(held, at, width), schema)
        if k < len(blocks) - 1:
            out = stored(out, "passages")  # one pass at a time
    return out.toDF(*names, "n_words", "spans", "items")


def _search(held, at: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(held.value, width)
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            n_words, spans, items = [], [], []
            for part in _parts(texts):
                n, s, i = patterns.search(part)
                n_words.append(n)
                spans += s
                items += i
            old = b.schema.names
            if "spans" in old:  # found by an earlier pass
                spans = [_merged([(x["first"], x["last"]) for x in a], s) if a and s else s or [(x["first"], x["last"]) for x in a]
                         for a, s in zip(b.column("spans").to_pylist(), spans, strict=True)]
                items = [i.union(a) for a, i in zip(b.column("items").to_pylist(), items, strict=True)]
                b = b.drop_columns(["n_words", "spans", "items"])
            new = [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                   pa.array([[{"first": x, "last": y} for x, y in s] for s in spans], _SPANS),
                   pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "n_words", "spans", "items"])

    return run


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in parts of at most ``TOGETHER`` bytes (or one longer text)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > TOGETHER:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, least_hit: int = 1, **cols: str) -> DataFrame:
    """``docs`` without those in which ``least_hit`` words or more are hit; columns and other rows as they are."""
    found = find_passages(docs, benchmark, width, **cols)
    names = docs.columns
    plain = found.toDF(*[f"_c{i}" for i in range(len(names))], "n_words", "spans", "items")
    return plain.filter(_hits("spans") < least_hit).drop("n_words", "spans", "items").toDF(*names)


def _hits(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of ``find_passages``."""
    names = found.columns
    plain = found.toDF(*[f"_c{i}" for i in range(len(names) - 3)], "n_words", "spans", "items")
    return plain.select(
        F.col(f"_c{names.index(id_col)}").alias("doc_id"), "n_words", _hits("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))
