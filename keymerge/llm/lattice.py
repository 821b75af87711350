"""Near-duplicate vectors by lattice hashing.

Random projections take a unit vector to 8 dimensions, and its nearest point of
the E8 lattice (the densest packing there, with a fast exact decoder) is its
cell in one table.  Several tables are kept, and each vector also probes the
neighbouring cells nearest to it.  Vectors that meet in a cell which is
the own cell of at least one of them are compared by cosine in double precision.

With more vectors a cell is the joint of several lattice points, so that the
vectors of a cell stay few; the number of tables follows from the probability
that two vectors at the threshold meet in one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entities import components
from .common import pick, prepare, stored

#: Projected distance of lattice points, neighbours probed per lattice point, and the share of
#: pairs at cosine 0.95 that then meet in a cell of one lattice point (measured: 0.53).
WIDTH, PROBES, MEET = 1.25, 4, 0.5
#: Pairs at the threshold that may be missed; vectors for which one lattice point suffices; further
#: vectors for each more.
MISSED, FEW, MORE = 0.0005, 131_072, 5_000
#: Members of a cell that one task compares at once, and pairs checked at once.
BLOCK, PAIRS = 1024, 20_000


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer point of even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    gap = y[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the even integer points or of those shifted by one half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def neighbours() -> np.ndarray:
    """The 240 shortest lattice vectors."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


@dataclass(frozen=True)
class Tables:
    """Cells of unit vectors of ``dims`` dimensions."""

    dims: int
    points: int = 1
    tables: int = 10
    probes: int = PROBES
    seed: int = 8

    @cached_property
    def projections(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.tables, self.points, self.dims, 8)) / WIDTH

    @cached_property
    def around(self) -> np.ndarray:
        return neighbours()

    def cells(self, x: np.ndarray) -> np.ndarray:
        """``(vectors, tables, 1 + probes)`` cell numbers, the own cell first."""
        per = 1 + self.probes
        out = np.empty((len(x), self.tables, per**self.points), np.int64)
        for t in range(self.tables):
            code = np.full((len(x), 1), np.uint64(t * 2 + 1), np.uint64)
            for p in range(self.points):
                y = x @ self.projections[t, p]
                own = nearest_e8(y)
                best = np.argsort(-((y - own) @ self.around.T), axis=1, kind="stable")[:, : self.probes]
                points = np.concatenate([own[:, None, :], own[:, None, :] + self.around[best]], axis=1)
                h = _hash_points(np.rint(2 * points).astype(np.int64))
                with np.errstate(over="ignore"):
                    code = (_mix(code * np.uint64(0x9E3779B97F4A7C15))[:, :, None] + h[:, None, :]).reshape(len(x), -1)
            out[:, t] = _mix(code).view(np.int64)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_points(points: np.ndarray) -> np.ndarray:
    out = np.zeros(points.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(points.shape[-1]):
            out = _mix(out * np.uint64(31) + points[..., k].astype(np.uint64))
    return out


def plan(vectors: int, dims: int) -> Tables:
    """Lattice points per cell and tables for so many vectors."""
    points = 1 if vectors <= FEW else 1 + math.ceil(math.log(vectors / FEW) / math.log(MORE))
    return Tables(dims, points, math.ceil(math.log(MISSED) / math.log(1 - MEET**points)))


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(v: list | None) -> bytes | None:
    if not v or None in v:
        return None
    a = np.array(v, np.float64)
    return a.tobytes() if np.isfinite(a).all() and a.any() else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [_usable(v) for v in b.column(1).to_pylist()]
        node = [xxhash.xxh3_128_digest(r) if r else None for r in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "node", "vector"])


def _same_cell(pairs: tuple[np.ndarray, np.ndarray], cells: np.ndarray, cell: int) -> np.ndarray:
    """Whether ``cell`` is the lowest in which the members of each pair meet: the one that counts it."""
    u, v = (cells[p] for p in pairs)
    lowest = np.full(len(u), np.iinfo(np.int64).max)
    for x, y in ((u, v), (v, u)):  # y's own cell is x's own or probed
        meet = (x == y[:, :, :1]).any(axis=2)
        lowest = np.minimum(lowest, np.where(meet, y[:, :, 0], np.iinfo(np.int64).max).min(axis=1))
    return lowest == cell


def _near(x: np.ndarray, own: np.ndarray, block: np.ndarray, between: bool, least: float) -> np.ndarray:
    """The pairs that this task compares: of two blocks only those between them, as tasks of one block hold the others."""
    near = x @ x.T >= least
    near &= own[:, None] | own
    if between:
        near &= block[:, None] != block
    np.fill_diagonal(near, False)
    return near


def _compare_cell(cell: int, near: np.ndarray, copies: np.ndarray, cells: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Adds each member's links found in this cell to ``links``; returns a spanning forest of them."""
    i, j = np.nonzero(np.triu(near, 1))
    up, forest = list(range(len(near))), []

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for s in range(0, len(i), PAIRS):
        a, b = i[s : s + PAIRS], j[s : s + PAIRS]
        count = _same_cell((a, b), cells, cell)
        a, b = a[count], b[count]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                forest.append((p, q))
    return forest


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors are linked if their cosine is ``least`` or more; ``component_id`` is the
    smallest id reachable by links.

    * Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    * Vectors of different lengths never link.  Equal vectors are one class with a number of
      rows (so are repeated rows) and are compared once.
    * A row without an id counts as a link of others; it is kept only if no row of its component has an id.
    * An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = stored(pick(vectors, vec_id=id_col, embedding=vector_col).mapInArrow(_read, "vec_id long, node binary, vector binary"), "vectors")
    classes = stored(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    # One plan per vector length; usually there is one.
    lengths = [(r.n // 8, r.c) for r in classes.groupBy(F.octet_length("vector").alias("n")).agg(F.count("*").alias("c")).collect()]
    plans = spark.sparkContext.broadcast({d: plan(c, d) for d, c in lengths})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, node = b.column(1).to_pylist(), np.array(b.column(0).to_pylist(), object)
            for d in {len(r) // 8 for r in raw}:
                at = [k for k, r in enumerate(raw) if len(r) == 8 * d]
                cells = plans.value[d].cells(_units([raw[k] for k in at]))
                flat = cells.reshape(len(at), -1)
                own = np.zeros(cells.shape[1:], bool)
                own[:, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node[at], flat.shape[1]), pa.binary()), pa.array(flat.ravel() ^ d), pa.array(np.tile(own.ravel(), len(at)))],
                    ["node", "cell", "own"])

    cells = classes.select("node", "vector").mapInArrow(spread, "node binary, cell long, own boolean")
    counts = stored(cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("any")).filter("any and n > 1"), "cells")
    tasks = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * BLOCK))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = (cells.join(counts, "cell").withColumns({"block": F.pmod(F.hash("node"), blocks), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
               .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"),
                             "task": F.when(F.col("n") > BLOCK, F.hex("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("string"))})
               .join(classes.select("node", "vector", "copies"), "node")
               .select("task", "i", "j", "cell", "own", "block", "node", "vector", "copies"))

    def compare(group: pa.Table) -> pa.Table:
        g = group.sort_by([("cell", "ascending"), ("node", "ascending")])
        node, cell = g.column("node").to_pylist(), g.column("cell").to_numpy()
        raw, copies, block, own = g.column("vector").to_pylist(), g.column("copies").to_numpy(), g.column("block").to_numpy(), g.column("own").to_numpy()
        between = g.column("i")[0].as_py() != g.column("j")[0].as_py()
        links, a, b = np.zeros(len(node), np.int64), [], []
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist() + [len(node)]
        for s, e in zip(starts, starts[1:], strict=False):
            d = len(raw[s]) // 8
            x = _units(raw[s:e])
            near = _near(x, own[s:e], block[s:e], between, least)
            some = np.flatnonzero(near.any(axis=1))  # the cells of the others are not needed
            if not len(some):
                continue
            k = s + some
            for p, q in _compare_part(int(cell[s]), d, x[some], near[np.ix_(some, some)], copies[k], plans.value[d], links, k):
                a.append(node[p])
                b.append(node[q])
        hit = np.flatnonzero(links)
        return pa.table({"a": pa.array([node[h] for h in hit] + a, pa.binary()), "b": pa.array([None] * len(hit) + b, pa.binary()),
                         "links": pa.array(links[hit].tolist() + [0] * len(a), pa.int64())})

    found = stored(members.groupBy("task", "i", "j").applyInArrow(compare, "a binary, b binary, links long"), "found")
    links = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    group = stored(components(found.filter(F.col("b").isNotNull()), "a", "b"), "groups")
    first = stored(group.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("lowest")), "firsts")
    label = stored(classes.select("node", "first", "copies").join(links, "node", "left").join(group.join(first, "component"), "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("lowest", "first").alias("component")), "labels")
    alone = F.when(F.col("node").isNull(), F.col("vec_id"))
    return (rows.select("vec_id", "node").join(label, "node", "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", alone).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())))


def _compare_part(cell: int, d: int, x: np.ndarray, near: np.ndarray, copies: np.ndarray, tables: Tables,
                  links: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    part = np.zeros(len(at), np.int64)
    forest = _compare_cell(cell, near, copies, tables.cells(x) ^ d, part)
    np.add.at(links, at, part)
    return [(int(at[p]), int(at[q])) for p, q in forest]
