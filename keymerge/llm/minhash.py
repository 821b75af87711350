"""Near-duplicate texts by SuperMinHash signatures, banding, verification and grouping.

A text's set holds its distinct word shingles.  SuperMinHash gives each
element a random permutation of the signature's slots and lowers slot by slot
in the order of the element's ranks: an element's value in a slot is its rank
there plus a random fraction.  Ranks of one element are correlated (all differ),
which lowers the variance; and since rank ``j`` gives values of at least ``j``,
the ranks are worked off in order and the work stops as soon as all slots
hold lower values.

Texts with equal sets form a class.  Classes that share a band are candidates,
confirmed on their full sets, and grouped by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entities import components
from .common import pick, prepare, small_side, stored, tidied
from .quality_rules import WordHashes

#: Slots of a signature and rows of a band: at a similarity of 0.8, one of the 16 bands agrees for 99.98 % of pairs.
SLOTS, BAND = 64, 4
#: Members of a bucket that one task compares at once.
BLOCK = 512
#: Estimated similarity below the threshold by more than this (five standard deviations) rules a pair out.
MARGIN = 0.25

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``width`` words, lower-cased in ASCII; of
    fewer words the whole sequence is the only one."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    width = min(width, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - width + 1] + np.uint64(width)
        for k in range(1, width):
            out = _mix(out) * np.uint64(31) + h[k : len(h) - width + 1 + k]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, as float64 of shape (sets, slots)."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    sig = np.full(len(sets) * slots, np.inf)
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    at = perm = None  # at rank 0 no permutation needs to be held
    for rank in range(slots):
        r = _mix(x + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = rank + (r >> np.uint64(40)).astype(np.int64) % (slots - rank)
        value = rank + (r & np.uint64(0xFFFFFFFFFF)).astype(np.float64) / 2.0**40
        if perm is None:
            slot = place
        else:  # one more step of each element's shuffle
            slot = perm[at, place]
            perm[at, place] = perm[at, rank]
        np.minimum.at(sig, owner * slots + slot, value)
        # A set is done once all its slots are below the next rank.
        open_ = (sig.reshape(-1, slots) >= rank + 1).any(axis=1)
        keep = open_[owner]
        if not keep.any():
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.int64), (int(keep.sum()), 1))
            x, owner, first = x[keep], owner[keep], place[keep]
            at = np.arange(len(x))
            perm[at, first] = 0
        elif keep.sum() < 0.7 * len(x):
            x, owner, perm = x[keep], owner[keep], perm[keep]
            at = np.arange(len(x))
    return sig.reshape(-1, slots)


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    bands = SLOTS // BAND
    for b in batches:
        sets = [shingles(t or b"", width, hashes) for t in b.column(1).cast(pa.binary()).to_pylist()]
        some = [s for s in sets if len(s)]
        keys = np.empty((0, bands), np.int64)
        prints = []
        if some:
            sig = np.concatenate([signatures(some[i : i + 64]) for i in range(0, len(some), 64)])
            bits = _mix(np.ascontiguousarray(sig).view(np.uint64))
            k = np.full((len(some), bands), 0, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(BAND):
                    k = _mix(k * np.uint64(31) + bits[:, j::BAND] + np.arange(bands, dtype=np.uint64))
            keys = k.view(np.int64)
            prints = [x.tobytes() for x in (bits >> np.uint64(48)).astype(np.uint16)]
        rows, i = [], 0
        for s in sets:
            if len(s):
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), keys[i], prints[i]))
                i += 1
            else:
                rows.append((None, None, None))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([r[0] for r in rows], pa.binary()),
             pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary()), b.column(2)],
            ["doc_id", "n_shingles", "node", "keys", "prints", "text_hash"])


def sign(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, node`` (digest of the set), ``keys`` (of its bands), ``prints`` (16 bits a slot), ``text_hash``."""
    prepare(docs.sparkSession)
    return pick(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        tidied(lambda it: _signed(it, width)), "doc_id long, n_shingles long, node binary, keys array<long>, prints binary, text_hash long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(node, items)``: the full sets of the wanted ``(doc_id, node)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t or b"", width, hashes) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), b.column(0)], ["node", "items", "doc_id"])

    ids = small_side(stored(wanted.select("doc_id").distinct(), "wanted"))
    made = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "node binary, items array<long>, doc_id long")
    # An id may come with several texts; a class may come with several rows.
    return stored(made.join(wanted, ["doc_id", "node"], "left_semi").dropDuplicates(["node"]).select("node", "items"), "sets")


def _agreement(a: str, b: str):
    """The part of the slots on which two signatures' prints agree."""
    same = F.expr(f"aggregate(sequence(1, {2 * SLOTS}, 2), 0, (n, i) -> n + if(substring({a}, i, 2) = substring({b}, i, 2), 1, 0))")
    return same / SLOTS


def _likely(classes: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` that join every two classes sharing a band, if their estimated
    similarity reaches ``least`` or a chain of such links connects them.

    In each bucket all members are held against the smallest: a row for each member, however
    large the bucket is.  Those too unlike it (few: sharing a band by chance) are compared
    with each other, and with the members like it, in tasks of bounded size, by their signatures alone.
    """
    prints = classes.select("node", "prints")
    members = classes.select("node", F.explode("keys").alias("key"))
    buckets = stored(members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    stars = stored(members.join(buckets, "key").filter(F.col("node") != F.col("leader")), "stars")
    pairs = (stars.select("node", "leader").distinct().join(prints, "node")
             .join(prints.select(F.col("node").alias("leader"), F.col("prints").alias("other")), "leader")
             .select("node", "leader", (_agreement("prints", "other") >= least).alias("near")))
    pairs = stored(pairs, "pairs")
    near = pairs.filter("near").select(F.col("node").alias("a"), F.col("leader").alias("b"))

    others = stars.filter("n > 2").join(pairs.filter("not near"), ["node", "leader"], "left_semi").select("node", "key")
    counts = others.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    others = stored(others.join(counts, "key").join(prints, "node"), "others")
    tasks = max(1, others.count() // BLOCK)
    rows = _in_blocks(others, "key", tasks).select("task", "i", "j", "key", "block", "node", "prints")

    def compare(group: pa.Table) -> pa.Table:
        a, b = [], []
        g = group.sort_by([("key", "ascending"), ("node", "ascending")])
        node, key, block = g.column("node").to_pylist(), g.column("key").to_numpy(), g.column("block").to_numpy()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(node)]
        prints = np.frombuffer(b"".join(g.column("prints").to_pylist()), np.uint16).reshape(len(node), -1)
        for s, e in zip(starts, starts[1:], strict=False):
            forest = _Forest(e - s)
            for x, y in zip(*_alike(prints[s:e], block[s:e], least)[:2], strict=True):
                if forest.join(x, y):
                    a.append(node[s + x])
                    b.append(node[s + y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    apart = rows.groupBy("task", "i", "j").applyInArrow(compare, "a binary, b binary")
    return near.unionByName(apart).unionByName(_across(stars, pairs, prints, least))


def _across(stars: DataFrame, pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` of each member unlike its bucket's smallest to a member that is like it.

    Those like it are linked with each other through it, so one link for each block of them is enough.
    Every block of the unlike is compared with every block of the like: few of the first mean few
    copies of the second.
    """
    sorted_out = stars.filter("n > 2").join(pairs, ["node", "leader"]).select("node", "key", "near")
    counts = sorted_out.groupBy("key").agg(F.count_if("near").alias("like"), F.count_if(~F.col("near")).alias("unlike")).filter("like > 0 and unlike > 0")
    members = stored(sorted_out.join(counts, "key").join(prints, "node"), "across")
    tasks = max(1, members.count() // BLOCK)
    blocks = {c: F.ceil(F.col(c) / BLOCK).cast("int") for c in ("like", "unlike")}
    own = {c: F.pmod(F.hash("node"), n) for c, n in blocks.items()}
    every = {c: F.sequence(F.lit(0), n - 1) for c, n in blocks.items()}
    task = F.when(F.col("like") + F.col("unlike") > BLOCK, F.hex("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("string"))
    rows = members.select("node", "key", "near", "prints", task.alias("task"), F.explode(F.when(F.col("near"), F.array(own["like"])).otherwise(every["like"])).alias("i"), "unlike")
    rows = rows.withColumn("j", F.explode(F.when(F.col("near"), every["unlike"]).otherwise(F.array(own["unlike"])))).drop("unlike")

    def compare(group: pa.Table) -> pa.Table:
        a, b = [], []
        g = group.sort_by([("key", "ascending"), ("near", "ascending"), ("node", "ascending")])
        node, key, like = g.column("node").to_pylist(), g.column("key").to_numpy(), g.column("near").to_numpy()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(node)]
        prints = np.frombuffer(b"".join(g.column("prints").to_pylist()), np.uint16).reshape(len(node), -1)
        for s, e in zip(starts, starts[1:], strict=False):
            first = s + int((~like[s:e]).sum())  # of the like ones
            if s == first or first == e:
                continue
            agree = np.zeros((first - s, e - first), np.uint8)
            for c in range(prints.shape[1]):
                agree += prints[s:first, None, c] == prints[None, first:e, c]
            best = agree.argmax(axis=1)
            for x in np.flatnonzero(agree[np.arange(first - s), best] >= least * SLOTS).tolist():
                a.append(node[s + x])
                b.append(node[first + int(best[x])])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("task", "i", "j").applyInArrow(compare, "a binary, b binary")


def _in_blocks(rows: DataFrame, group: str, tasks: int) -> DataFrame:
    """Deal groups of ``n`` rows out to tasks of bounded size: small groups several to a task,
    those of over ``BLOCK`` rows as pairs ``(i, j)`` of blocks (each row once for every block)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return (rows.withColumns({"block": F.pmod(F.hash("node"), blocks), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
            .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"),
                          "task": F.when(F.col("n") > BLOCK, F.hex(group)).otherwise(F.pmod(F.xxhash64(group), F.lit(tasks)).cast("string"))}))


def _alike(prints: np.ndarray, block: np.ndarray, least: float, also: np.ndarray | None = None) -> tuple[list[int], list[int], np.ndarray]:
    """Pairs of rows (of two blocks: between the blocks) that agree on ``least`` of the slots."""
    agree = np.zeros((len(prints), len(prints)), np.uint8)
    for c in range(prints.shape[1]):
        agree += prints[:, None, c] == prints[None, :, c]
    near = agree >= least * SLOTS
    if also is not None:
        near &= also
    if block.min() != block.max():
        near &= block[:, None] != block
    i, j = np.nonzero(np.triu(near, 1))
    return i.tolist(), j.tolist(), agree[i, j]


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(keys: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], block: np.ndarray, percent: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links among the members of a cluster (of two blocks of
    it: between the blocks).  Pairs are tried from the most alike down; pairs already connected are skipped."""
    n = len(sets)
    share = np.zeros((n, n), bool)
    for c in range(keys.shape[1]):
        share |= keys[:, None, c] == keys[None, :, c]
    size = np.fromiter(map(len, sets), np.int64, n)
    share &= 100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)
    i, j, agree = _alike(prints, block, least, share)
    forest, out = _Forest(n), []
    for k in np.argsort(-agree.astype(np.int16), kind="stable").tolist():
        a, b = i[k], j[k]
        if forest.find(a) != forest.find(b) and _similar(sets[a], sets[b], percent):
            forest.join(a, b)
            out.append((a, b))
    return out


def _confirmed(docs: DataFrame, classes: DataFrame, likely: DataFrame, width: int, percent: int, least: float) -> DataFrame:
    """Confirmed links ``(a, b)``: enough of them to connect what links connect.

    Clusters of likely links are compared in tasks of bounded size: small clusters several
    to a task, large ones as pairs of blocks.
    """
    cluster = stored(components(likely, "a", "b"), "clusters")
    sizes = stored(cluster.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    members = stored(cluster.join(sizes, "component").join(classes, "node"), "members")
    sets = _sets(docs, members.select("doc_id", "node"), width)
    tasks = max(1, cluster.count() // BLOCK)
    rows = (_in_blocks(members, "component", tasks).join(sets, "node")
            .select("task", "i", "j", "component", "block", "node", "keys", "prints", "items"))

    def compare(group: pa.Table) -> pa.Table:
        a, b = [], []
        g = group.sort_by([("component", "ascending"), ("node", "ascending")])
        node, part = g.column("node").to_pylist(), g.column("component").to_pylist()
        block = g.column("block").to_numpy()
        starts = [k for k in range(len(part)) if not k or part[k] != part[k - 1]] + [len(part)]
        for s, e in zip(starts, starts[1:], strict=False):
            keys = np.array([x.as_py() for x in g.column("keys")[s:e]], np.int64)
            prints = np.frombuffer(b"".join(x.as_py() for x in g.column("prints")[s:e]), np.uint16).reshape(e - s, -1)
            sets = [np.asarray(x.values).view(np.uint64) for x in g.column("items")[s:e]]
            for x, y in _links(keys, prints, sets, block[s:e], percent, least):
                a.append(node[s + x])
                b.append(node[s + y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("task", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts are linked if their sets of distinct ``width``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more; ``component_id`` is the smallest id of all texts
    reachable by links.  All texts are read whole.

    * Null, empty and blank texts have no shingle, link with nothing and are kept.
    * Equal sets are one class, however many rows hold it (so are repeated rows).
    * A row without an id takes its class' component (null if no row of it has an id) and is
      kept only if there is none.
    * An empty table gives no rows; other columns are ignored.
    """
    rows, classes, group = _grouped(pick(docs, doc_id=id_col, text=text_col), width, percent)
    least_id = stored(group.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("first")), "firsts")
    grouped = group.join(least_id, "component").select("node", "first")
    label = stored(classes.select("node", "doc_id").join(grouped, "node", "left").select("node", F.coalesce("first", "doc_id").alias("component")), "labels")
    alone = F.when(F.col("node").isNull(), F.col("doc_id"))
    return (rows.select("doc_id", "n_shingles", "node").join(label, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", alone).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, their classes, and ``(node, component)`` of the classes that have links."""
    least = percent / 100 - MARGIN
    rows = stored(sign(docs, width), "signed")
    named = rows.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("prints").alias("prints")), "classes")
    links = stored(_confirmed(docs, classes, _likely(classes, least), width, percent, least), "links")
    return rows, classes, stored(components(links, "a", "b"), "groups")


def copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash, rows, kept`` for every id and text (``xxhash64``); rows without an id are left out.

    One text of each group of near duplicates is kept: of those of the smallest id the one with the
    lowest digest, then hash.  An id may come with several texts: each has its own verdict.  Texts without
    a shingle are kept.
    """
    rows, _, group = _grouped(pick(docs, doc_id="doc_id", text="text"), width, percent)
    texts = stored(rows.filter("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.first("node").alias("node"), F.count("*").alias("rows"))
                   .join(group, "node", "left").withColumn("component", F.coalesce("component", "node")), "texts")
    one = F.min(F.struct("doc_id", "node", "text_hash"))
    first = stored(texts.filter("node is not null").groupBy("component").agg(one.alias("one")).select("one.doc_id", "one.text_hash", F.lit(True).alias("first")), "kept")
    return (texts.join(first, ["doc_id", "text_hash"], "left")
            .select("doc_id", "text_hash", "rows", (F.col("node").isNull() | F.coalesce("first", F.lit(False))).alias("kept")))
