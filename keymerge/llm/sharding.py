"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible.  Sorted by size, each group enters the
shard with the tightest remaining room that holds it, found in a balanced
search tree over the rooms; where none holds it, the emptiest shard takes it.

What is packed stays small at any input size: a group that is large against a
shard is an item of its own (there can only be few); the many small groups are
gathered, by size class and hash, into chunks of a bounded number.  Chunks of
the smallest groups are finer, as they are placed last and level the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored

#: A group of over 1 / CHUNKS of a shard is an item; so many chunks are made of a shard's bytes of small groups.
CHUNKS = 64
#: The part of all bytes, in the smallest groups, that is cut into chunks FINER times as fine.
TAIL, FINER = 0.02, 64
#: Rows that are numbered by one task.
SLOT_ROWS = 50_000


class Rooms:
    """A treap of ``(room, shard)``: a randomised balanced search tree, its priorities hashed."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, room: int, shard: int) -> None:
        key = (room, shard)
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, [key, hash((shard, room)), None, None]), b)

    def remove(self, room: int, shard: int) -> None:
        a, b = self._split(self.root, (room, shard))
        _, c = self._split(b, (room, shard + 1))
        self.root = self._join(a, c)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least room of at least ``size``."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def emptiest(self) -> tuple[int, int]:
        node = self.root
        while node[3] is not None:
            node = node[3]
        return node[0]


def best_fit_decreasing(items: list[tuple], shards: int) -> dict[tuple, int]:
    """``items``: ``(size, *key)``; returns the shard of each item.

    The capacity is the mean load of the shards, after items larger than the mean of
    what remains have taken a shard each.
    """
    order = sorted(items, key=lambda x: (-x[0], x[1:]))
    total, alone = sum(x[0] for x in order), 0
    while alone < min(shards - 1, len(order)) and order[alone][0] * (shards - alone) > total:
        total -= order[alone][0]
        alone += 1
    capacity = -(-total // (shards - alone))
    place = {x: i for i, x in enumerate(order[:alone])}
    rooms = Rooms()
    for shard in range(alone, shards):
        rooms.add(capacity, shard)
    for x in order[alone:]:
        room, shard = rooms.tightest(x[0]) or rooms.emptiest()
        rooms.remove(room, shard)
        rooms.add(room - x[0], shard)
        place[x] = shard
    return place


def _small_key(size: Column, key: Column, widths: list[tuple[int, int]]) -> Column:
    """Chunk number of a small group: its size class' chunks are dealt by hash."""
    n = F.create_map(*[F.lit(v) for kv in widths for v in kv]) if widths else F.create_map(F.lit(0), F.lit(1))
    c = F.floor(F.log2(size)).cast("int")
    return F.pmod(key, F.coalesce(n[c], F.lit(1)).cast("long"))


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``bytes``.

    * Size: UTF-8 bytes of the text (null: none) plus ``overhead``.  Null texts are a group,
      and so are empty ones.
    * A group of equal texts goes to one shard.  Only a group larger than a shard's share of
      all bytes is cut, into parts dealt by hashed id of at most about half a share each, as no
      shard could hold it.
    * Repeated rows each have a row; an empty table gives none; other columns are ignored.
    * Slots count from 0 without a gap in each shard.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = stored(pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("g1"), F.hash(F.reverse(text), F.isnull(text)).alias("g2")), "rows")
    groups = stored(rows.groupBy("g1", "g2", "size", "text_crc32").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = -(-total // shards) or 1

    # Groups that no shard can hold: few, as each has over a share of all bytes.
    huge = groups.filter(F.col("bytes") > share).withColumn("parts", F.ceil(F.col("bytes") * 2 / share)).drop("bytes")
    keys = ["g1", "g2", "size", "text_crc32"]
    rows = rows.join(F.broadcast(huge), keys, "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("long")).drop("parts")
    groups = groups.filter(F.col("bytes") <= share).withColumn("part", F.lit(0).cast("long")).unionByName(
        rows.join(F.broadcast(huge), keys, "left_semi").groupBy(*keys, "part").agg(F.sum("size").alias("bytes")))

    least = share // CHUNKS
    large = groups.filter(F.col("bytes") > least)
    small = groups.filter(F.col("bytes") <= least)
    widths = _widths(small, total, share)
    number = _small_key(F.col("bytes"), F.col("g1"), widths)
    level = F.floor(F.log2("bytes")).cast("int")
    chunks = small.groupBy(level.alias("level"), number.alias("number")).agg(F.sum("bytes").alias("bytes"))

    # At most shards * CHUNKS large groups, and the chunks that the widths allow.
    items = [(r.bytes, 0, r.g1, r.g2, r.size, r.text_crc32, r.part) for r in large.collect()]
    items += [(r.bytes, 1, r.level, r.number) for r in chunks.collect()]
    place = best_fit_decreasing(items, shards)
    own = _frame(spark, [(*k[2:], s) for k, s in place.items() if k[1] == 0],
                 "g1 long, g2 int, size long, text_crc32 long, part long, own_shard int")
    dealt = _frame(spark, [(*k[2:], s) for k, s in place.items() if k[1] == 1], "level int, number long, dealt_shard int")
    # Small groups' bytes are needed for their class: rows join their group, dealt by its key.
    by_group = (groups.withColumns({"level": level, "number": number}).drop("bytes")
                .join(F.broadcast(own), [*keys, "part"], "left").join(F.broadcast(dealt), ["level", "number"], "left")
                .select(*keys, "part", F.coalesce("own_shard", "dealt_shard").alias("shard")))
    placed = stored(rows.join(by_group, [*keys, "part"]).drop("part", "g1", "g2"), "placed")
    return _with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                      F.lit(None).cast("int").alias("grown_shard"))


def _widths(small: DataFrame, total: int, share: int) -> list[tuple[int, int]]:
    """Chunks per size class (at most 64 classes); classes that hold the smallest ``TAIL`` of all bytes get finer ones."""
    classes = small.groupBy(F.floor(F.log2("bytes")).cast("int").alias("level")).agg(F.sum("bytes").alias("b")).orderBy("level").collect()
    out, below = [], 0
    for r in classes:
        fine = FINER if below < TAIL * total else 1
        below += r.b
        if fine > 1 and below > 4 * TAIL * total:
            fine = max(1, int(FINER * TAIL * total / r.b))
        out.append((r.level, max(1, -(-r.b * CHUNKS * fine // share))))
    return out


def _frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0: within buckets of some rows, on top of the buckets before.

    Rows are dealt to buckets by a number of their own, written once, so that many rows of one id,
    of none, or alike in all go to many buckets.
    """
    from pyspark.sql import Window

    cut = stored(placed.withColumn("_row", F.monotonically_increasing_id()), "placed")
    buckets = max(1, -(-cut.count() // SLOT_ROWS))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(buckets)).cast("int")).drop("_row")
    counts = stored(cut.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "buckets")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return cut.withColumn("row", number).join(before, ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("row") - 1).cast("long"))
