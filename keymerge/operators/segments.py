"""Type ranges that tolerate stray values (T7 with confidence below 1).

The best division of a column into ranges costs one for each value whose type is not its
range's, and ``penalty`` for each change of type from one range to the next.  The programme
that finds it goes over the runs of equal type in order and keeps, per type, the least cost of
ending in it.  It is cut at partition edges: each partition gives the cost of leaving in
type ``j`` when entered in type ``i`` (a table of types by types); these tables are combined
over the partitions in order, which gives every partition its costs at entry; each then
gives where its best paths came from; and once the types at all edges are known, its
ranges.  Between the passes there is one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantic import SEMANTIC_TYPES
from ..session import materialize, ship_code

_K = len(SEMANTIC_TYPES)
_AT = {t: k for k, t in enumerate(SEMANTIC_TYPES)}
_FAR = 1 << 60


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the cost of each run under each type; values without a type fit all."""
    for b in batches:
        n = b.column(b.schema.get_field_index("n_rows")).to_numpy()
        cost = np.repeat(n[:, None], _K, axis=1)
        for k, t in enumerate(b.column(b.schema.get_field_index("semantic_type")).to_pylist()):
            if t is None:
                cost[k] = 0
            else:
                cost[k, _AT[t]] = 0
        yield b, cost


def _step(f: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs before the next run's own, and the type that each path comes from: its own, or else the first of the cheapest."""
    best = int(f.argmin())
    change = f > f[best] + penalty
    return np.where(change, f[best] + penalty, f), np.where(change, best, np.arange(_K))


def segment(costs: np.ndarray, penalty: int) -> np.ndarray:
    """The programme on one machine: the type of each run."""
    f, back = np.zeros(_K, np.int64), []
    for c in costs:
        f, come = _step(f, penalty)
        f = f + c
        back.append(come)
    labels = np.zeros(len(costs), np.int64)
    at = int(f.argmin())
    for k in range(len(costs) - 1, -1, -1):
        labels[k] = at
        at = int(back[k][at])
    return labels


def _tables(penalty: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, f = None, np.full((_K, _K), _FAR, np.int64)
        np.fill_diagonal(f, 0)
        for b, cost in _runs(batches):
            pid = b.column(0)[0].as_py() if pid is None and b.num_rows else pid
            for c in cost:
                f = np.minimum(f, f.min(axis=1, keepdims=True) + penalty) + c
        if pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int64()), pa.array([f.ravel().tolist()], pa.list_(pa.int64()))], ["pid", "table"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs at the entry of each partition, tables coming in order."""
    f = np.zeros(_K, np.int64)
    for b in batches:
        out = []
        for table in b.column(1).to_pylist():
            out.append(f.tolist())
            f = (f[:, None] + np.array(table, np.int64).reshape(_K, _K)).min(axis=0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["pid", "entry"])


def _origins(penalty: int):
    """Per partition, where the best path to each type at its end entered, and the cheapest end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, f, origin = None, None, np.arange(_K)
        for b, cost in _runs(batches):
            if pid is None and b.num_rows:
                pid, f = b.column(0)[0].as_py(), np.array(b.column(4)[0].as_py(), np.int64)
            for c in cost:
                f, come = _step(f, penalty)
                f, origin = f + c, origin[come]
        if pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int64()), pa.array([origin.tolist()], pa.list_(pa.int64())), pa.array([int(f.argmin())], pa.int64())],
                                             ["pid", "origin", "cheapest"])

    return run


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The type at the end of each partition, from the last to the first."""
    at = None
    for b in batches:
        out = []
        for origin, cheapest in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            at = cheapest if at is None else at
            out.append(at)
            at = origin[at]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["pid", "exit"])


_RANGES = "pid long, seq long, start_row long, n_rows long, label long, hits long, typed long"


def _ranges(penalty: int):
    """The ranges of a partition, of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, f, at, back, starts, sizes, types = None, None, 0, [], [], [], []
        for b, cost in _runs(batches):
            if pid is None and b.num_rows:
                pid, f, at = b.column(0)[0].as_py(), np.array(b.column(4)[0].as_py(), np.int64), b.column(5)[0].as_py()
            for c in cost:
                f, come = _step(f, penalty)
                f = f + c
                back.append(come.astype(np.int8))
            starts.append(b.column(1).to_numpy())
            sizes.append(b.column(2).to_numpy())
            types += [-1 if t is None else _AT[t] for t in b.column(3).to_pylist()]
        if pid is None:
            return
        label = np.zeros(len(back), np.int64)
        for k in range(len(back) - 1, -1, -1):
            label[k] = at
            at = int(back[k][at])
        start, size, kind = np.concatenate(starts), np.concatenate(sizes), np.array(types)
        first = np.flatnonzero(np.append(True, label[1:] != label[:-1]))

        def total(x):
            return pa.array(np.add.reduceat(x, first))

        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), pid)), pa.array(np.arange(len(first))), pa.array(start[first]), total(size), pa.array(label[first]),
             total(np.where(kind == label, size, 0)), total(np.where(kind >= 0, size, 0))],
            ["pid", "seq", "start_row", "n_rows", "label", "hits", "typed"])

    return run


def noisy_ranges(runs: DataFrame, penalty: int, partitions: int) -> DataFrame:
    """``start_row, end_row, n_rows, semantic_type, confidence`` from runs ``start_row, n_rows, semantic_type``.

    ``confidence`` is the share of the range's type among its values that have one; a range
    without any has neither.  Of equally cheap divisions the one is taken that changes type
    as late as it can and prefers types in the order of ``SEMANTIC_TYPES``.
    """
    if penalty < 1:
        raise ValueError("the penalty must be at least 1")
    ship_code(runs.sparkSession)
    number = F.monotonically_increasing_id()
    rows = materialize(runs.select("start_row", F.col("n_rows").cast("bigint").alias("n_rows"), "semantic_type")
                       .repartitionByRange(partitions, "start_row").sortWithinPartitions("start_row")
                       .select(F.shiftright(number, 33).alias("pid"), "start_row", "n_rows", "semantic_type", number.bitwiseAND(F.lit((1 << 33) - 1)).alias("seq")))
    plain = rows.select("pid", "start_row", "n_rows", "semantic_type")

    def in_order(df: DataFrame, *by) -> DataFrame:
        return df.coalesce(1).sortWithinPartitions(*by)  # one row per partition

    tables = materialize(plain.mapInArrow(_tables(penalty), "pid long, table array<long>"))
    entries = materialize(in_order(tables, "pid").mapInArrow(_entries, "pid long, entry array<long>"))
    # What a partition gets is put beside its first run.
    begun = rows.join(F.broadcast(entries.withColumn("seq", F.lit(0).cast("long"))), ["pid", "seq"], "left")
    origins = materialize(begun.select("pid", "start_row", "n_rows", "semantic_type", "entry").mapInArrow(_origins(penalty), "pid long, origin array<long>, cheapest long"))
    exits = materialize(in_order(origins, F.desc("pid")).mapInArrow(_exits, "pid long, exit long"))
    ended = begun.join(F.broadcast(exits.withColumn("seq", F.lit(0).cast("long"))), ["pid", "seq"], "left")
    local = materialize(ended.select("pid", "start_row", "n_rows", "semantic_type", "entry", "exit").mapInArrow(_ranges(penalty), _RANGES))
    # Ranges that go on over an edge belong to the partition in which they begin.
    w = Window.orderBy("pid")  # one row per partition
    edges = (local.groupBy("pid").agg(F.max("seq").alias("last"), F.min_by("label", "seq").alias("first"), F.max_by("label", "seq").alias("final"))
             .withColumn("goes_on", F.coalesce(F.col("first") == F.lag("final").over(w), F.lit(False)))
             .withColumn("begins", F.when(~((F.col("last") == 0) & F.col("goes_on")), F.struct("pid", "last")))
             .withColumn("owner", F.last("begins", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    joined = local.join(F.broadcast(edges.select("pid", "goes_on", "owner")), "pid")
    moved = (F.col("seq") == 0) & F.col("goes_on")
    whole = (joined.groupBy(F.when(moved, F.col("owner.pid")).otherwise(F.col("pid")).alias("p"), F.when(moved, F.col("owner.last")).otherwise(F.col("seq")).alias("s"))
             .agg(F.min("start_row").alias("start_row"), F.sum("n_rows").alias("n_rows"), F.first("label").alias("label"),
                  F.sum("hits").alias("hits"), F.sum("typed").alias("typed")))
    name = F.element_at(F.array(*[F.lit(t) for t in SEMANTIC_TYPES]), (F.col("label") + 1).cast("int"))
    some = F.col("typed") > 0
    return whole.select("start_row", (F.col("start_row") + F.col("n_rows") - 1).alias("end_row"), "n_rows", F.when(some, name).alias("semantic_type"),
                        F.when(some, F.col("hits") / F.col("typed")).alias("confidence"))
