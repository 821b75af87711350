"""Delimited files with line breaks inside quotes, read in parallel.

Whether a line break ends a record depends on all text before it, so a plain reader
takes such a file in one task.  Here every input split (a byte range of a file) is read
by itself, line by line, for *both* states it may begin in: outside a record or inside a
quoted field.  A first pass gives, per split, the state it ends in from either beginning
and the pieces of records that cross its edges.  The states of all splits follow from a
running combination over one row per split, and pieces are stitched there.  A second pass,
now with the true beginnings, gives the records that lie within a split.  No text is
shuffled but the pieces, and no task reads more than its splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_code


class Quotes:
    """Follows quoted fields over lines.  A quote opens a field only at its start, and within a
    quoted field two quotes stand for one; text after the closing quote belongs to the field."""

    def __init__(self, sep: str = ",", quote: str = '"'):
        if len(sep) != 1 or len(quote) != 1 or sep == quote:
            raise ValueError("separator and quote must be two different characters")
        q, s = re.escape(quote), re.escape(sep)
        body = f"(?:[^{q}]++|{q}{q})*+"
        self.quote = quote
        self._opens = re.compile(rf"(?:(?:{q}{body}{q}[^{s}]*+|[^{q}{s}][^{s}]*+|){s})*+{q}{body}\Z")
        self._closes = re.compile(f"{body}{q}[^{s}]*+")

    def after(self, line: str, inside: bool) -> bool:
        """Whether the line break after ``line`` lies inside a quoted field."""
        at = 0
        if inside:
            m = self._closes.match(line)
            if m is None:
                return True
            if m.end() == len(line):
                return False
            at = m.end() + 1
        return self._opens.match(line, at) is not None

    def records(self, text: str) -> list[str]:
        """The records of a whole text, without those that are empty."""
        out, held, inside = [], [], False
        for line in text.split("\n"):
            held.append(line)
            inside = self.after(line, inside)
            if not inside:
                out.append(_record("\n".join(held)))
                held = []
        if held:
            out.append(_record("\n".join(held)))
        return [r for r in out if r]


def _record(text: str) -> str:
    return text[:-1] if text.endswith("\r") else text


class _Split:
    """One split seen from one beginning: its state, whether a record has ended, whether one that is
    not empty lies within, and the pieces at its edges."""

    def __init__(self, inside: bool):
        self.inside, self.ended, self.full, self.head, self.tail = inside, not inside, False, [], []

    def plain(self, lines: list[str]) -> None:
        """Lines without a quote: they change no state."""
        if self.inside:
            (self.tail if self.ended else self.head).extend(lines)
        elif not self.full:
            self.full = any(map(_record, lines))

    def add(self, line: str, inside: bool) -> None:
        (self.tail if self.ended else self.head).append(line)
        if not inside:  # a record ends here; it holds a quote, so it is not empty
            self.full, self.ended, self.tail = self.full or self.ended, True, []
        self.inside = inside


_EDGES = pa.schema([("file", pa.string()), ("block", pa.int64()), *[(f"{k}{i}", t) for i in (0, 1) for k, t in
                    (("inside", pa.bool_()), ("full", pa.bool_()), ("head", pa.string()), ("tail", pa.string()))]])
_EDGES_DDL = "file string, block long, " + ", ".join(f"inside{i} boolean, full{i} boolean, head{i} string, tail{i} string" for i in (0, 1))


def _edges(quotes: Quotes):
    """Per split, from both beginnings: the state at its end and the open pieces."""

    def row(key: tuple, seen: list[_Split]) -> pa.RecordBatch:
        values = [*key]
        for s in seen:
            values += [s.inside, s.full, "\n".join(s.head) if s.head else None, "\n".join(s.tail) if s.tail else None]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _EDGES, strict=True)], schema=_EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, []
        for b in batches:
            for new, start, end in _splits(b):
                if new != key:
                    if key:
                        yield row(key, seen)
                    key, seen = new, [_Split(False), _Split(True)]
                lines = b.column(2).slice(start, end - start)
                quoted = pc.indices_nonzero(pc.match_substring(lines, quotes.quote)).to_pylist()
                at = 0
                for k in [*quoted, len(lines)]:
                    plain = lines.slice(at, k - at).to_pylist() if k > at and any(s.inside or not s.full for s in seen) else []
                    for s in seen:
                        s.plain(plain)
                    if k < len(lines):
                        line = lines[k].as_py()
                        for s in seen:
                            s.add(line, quotes.after(line, s.inside))
                    at = k + 1
        if key:
            yield row(key, seen)

    return run


def _splits(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Runs of rows of one split in a batch."""
    files, blocks = b.column(0).dictionary_encode(), b.column(1)
    code, block = files.indices.to_numpy(zero_copy_only=False), blocks.to_numpy(zero_copy_only=False)
    change = [k for k in range(1, b.num_rows) if code[k] != code[k - 1] or block[k] != block[k - 1]] if b.num_rows and (
        code[0] != code[-1] or block[0] != block[-1] or len(set(block.tolist())) > 1) else []
    for start, end in zip([0, *change], [*change, b.num_rows], strict=True):
        if end > start:
            yield (files.dictionary[int(code[start])].as_py(), int(block[start])), start, end


_RECORDS = "file string, block long, seq long, record string"


def _inner(quotes: Quotes):
    """The records that begin and end in one split, given the state in which it begins (column 3); without
    the first of them where column 4 says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, skip, drop, held, seq = None, False, False, False, [], 0
        for b in batches:
            for new, start, end in _splits(b):
                if new != key:
                    key, seq, held = new, 0, []
                    inside = skip = b.column(3)[start].as_py()  # what comes before the first record is a piece
                    drop = b.column(4)[start].as_py()
                lines = b.column(2).slice(start, end - start)
                quoted = pc.indices_nonzero(pc.match_substring(lines, quotes.quote)).to_pylist()
                out, at = [], 0
                for k in [*quoted, len(lines)]:
                    if k > at:
                        plain = lines.slice(at, k - at).to_pylist()
                        if not inside:
                            out += plain
                        elif not skip:
                            held += plain
                    if k < len(lines):
                        line = lines[k].as_py()
                        after = quotes.after(line, inside)
                        if not skip:
                            held.append(line)
                            if not after:
                                out.append("\n".join(held) if len(held) > 1 else line)
                                held = []
                        elif not after:
                            skip = False
                        inside = after
                    at = k + 1
                out = [r for r in map(_record, out) if r]
                if drop and out:
                    out, drop = out[1:], False
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(out), pa.string()), pa.array([key[1]] * len(out), pa.int64()),
                     pa.array(range(seq, seq + len(out)), pa.int64()), pa.array(out, pa.string())],
                    ["file", "block", "seq", "record"])
                seq += len(out)

    return run


def read_records(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"', header: bool = False) -> DataFrame:
    """``file, block, seq, record``: every record of the delimited text files, in file order by the
    first three (``block`` is the byte at which the record's split begins; a record that crosses
    an edge belongs to the split in which it begins, and comes last there).

    Lines end in ``\\n`` or ``\\r\\n``; empty lines outside quotes are left out.  A quote that is
    never closed runs to the end of its file.  With ``header`` the first record of each file is left out.  Splits are those of Spark's text reader
    (``spark.sql.files.maxPartitionBytes``); the tables over them have one row per split.
    """
    ship_code(spark)
    quotes = Quotes(sep, quote)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    edges = materialize(lines.mapInArrow(_edges(quotes), _EDGES_DDL), "edges")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # From either beginning a split ends outside (0) or inside (1).  If both give the same, later states
    # do not depend on earlier ones; else it keeps the state or turns it round.
    fixed, turns = F.col("inside0") == F.col("inside1"), (F.col("inside0") & ~F.col("inside1")).cast("int")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    state = (edges.withColumn("_turns", F.sum(turns).over(upto))
             .withColumn("_known", F.when(fixed, F.struct(F.col("inside0").cast("int").alias("to"), F.col("_turns").alias("at"))))
             .withColumn("_last", F.last("_known", ignorenulls=True).over(before))
             .withColumn("_sum", F.coalesce(F.max("_turns").over(before), F.lit(0)))
             .withColumn("begins", (F.coalesce(F.col("_last.to"), F.lit(0)) + F.col("_sum") - F.coalesce(F.col("_last.at"), F.lit(0))) % 2 == 1))
    seen = {c: F.when(F.col("begins"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("full", "head", "tail")}
    state = state.select("file", "block", "begins", *[e.alias(c) for c, e in seen.items()])
    if header:  # it stands in the first split that a record begins in
        first = F.min(F.when(F.col("full") | F.col("tail").isNotNull(), F.col("block"))).over(Window.partitionBy("file"))
        state = state.withColumn("header", F.coalesce(F.col("block") == first, F.lit(False)))
    else:
        state = state.withColumn("header", F.lit(False))
    state = materialize(state, "states")
    pieces = state.select("file", "block", (F.col("header") & ~F.col("full")).alias("header"), F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.col("head").alias("text")), F.struct(F.lit(1).alias("place"), F.col("tail").alias("text")))).alias("p"))
    # A piece at a split's end begins a record; pieces at beginnings go on with the last one begun.
    order = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (pieces.select("file", "block", "header", "p.*").filter(F.col("text").isNotNull())
              .withColumn("start", F.last(F.when(F.col("place") == 1, F.col("block")), ignorenulls=True).over(order)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda p: p["text"]), "\n")
    crossing = (pieces.groupBy("file", "start").agg(text.alias("record"), F.bool_or((F.col("place") == 1) & F.col("header")).alias("header"))
                .filter(~F.col("header"))
                .select("file", F.col("start").alias("block"), F.lit((1 << 63) - 1).alias("seq"), F.regexp_replace("record", r"\r\z", "").alias("record")))
    # One row per split, as many as the driver lists to plan the scan.
    begins = F.broadcast(state.select("file", "block", "begins", "header"))
    whole = lines.join(begins, ["file", "block"]).select("file", "block", "value", "begins", "header").mapInArrow(_inner(quotes), _RECORDS)
    return whole.unionByName(crossing).filter(F.col("record") != "")


def position() -> Column:
    """The order of ``read_records``' rows, as one value."""
    return F.struct("file", "block", "seq")


#: Bytes of text that a task splits at a time.
TEXT_BYTES = 4 << 20


def _text_parts(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``TEXT_BYTES`` of text, or of one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < b.num_rows:
        before = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + TEXT_BYTES, "right")))
        yield b.slice(start, end - start)
        start = end


def explode_records(df: DataFrame, text_col: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """All other columns of ``df`` and, for each record of its text, ``_line_no`` (from 0) and ``_line``.

    The text itself is not repeated for its records, and a task holds the records of a few megabytes of text at a time."""
    ship_code(df.sparkSession)
    quotes, at = Quotes(sep, quote), df.columns.index(text_col)
    names = [c for c in df.columns if c != text_col]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    kept = [k for k in range(len(df.columns)) if k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _text_parts(batch, at):
                found = [quotes.records(t) if t else [] for t in b.column(at).to_pylist()]
                rows = pa.array([k for k, r in enumerate(found) for _ in r], pa.int64())
                new = [pa.array([n for r in found for n in range(len(r))], pa.int32()), pa.array([x for r in found for x in r], pa.string())]
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(rows) for k in kept], *new], [*[b.schema.names[k] for k in kept], "_line_no", "_line"])

    schema = ", ".join([*[f"_c{k} {plain.schema[k].dataType.simpleString()}" for k in kept], "_line_no int, _line string"])
    return plain.mapInArrow(run, schema).toDF(*names, "_line_no", "_line")
