"""Ordered lists of a key in chunks of bounded size (P9-P11 for keys of any size).

A list per key puts all rows of a key into one cell.  Here the rows are range-partitioned by key
and order, so that a key with much of the data spans many tasks; each row's place in its
key's list is its place in its partition on top of the counts of the partitions before;
and chunks of places are gathered, none of which is larger than the bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policies import src_col
from ..session import materialize
from ..spec import SpecError

_SEQ = (1 << 33) - 1


def places(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """``df`` with ``_place``: the number of each row among the rows of its key, from 0, in the given order.

    Null keys are one key; rows of equal order come in any order, but each has a place of its own.
    """
    for c in ("_place", "_pid", "_seq"):
        if c in df.columns:
            raise SpecError(f"the column name {c} is taken")
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [src_col(c) if isinstance(c, str) else c for c in order_by]
    by = [src_col(k) for k in keys] + order
    number = F.monotonically_increasing_id()
    # Written once: partitions, and so places, stay as they are if tasks run again.
    rows = materialize(df.repartitionByRange(p, *by).sortWithinPartitions(*by)
                       .withColumn("_n", number).withColumns({"_pid": F.shiftright("_n", 33), "_seq": F.col("_n").bitwiseAND(F.lit(_SEQ))}).drop("_n"))
    named = [src_col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    # One row for each key and partition that holds it: as many as keys, and at most one more per partition.
    held = rows.groupBy(*named, "_pid").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")).drop("_first", "_count")
    same = [src_col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    starts = materialize(starts.withColumnRenamed("_pid", "_p"))
    cond = F.col("_pid") == F.col("_p")
    for s in same:
        cond = cond & s
    return rows.join(starts, cond).withColumn("_place", F.col("_seq") + F.col("_before")).select(*[src_col(c) for c in df.columns], "_place")


def chunked_values(df: DataFrame, keys: Sequence[str], value: str | Column, order_by: Sequence[str | Column], chunk: int = 10_000,
                   skip_nulls: bool = False, partitions: int | None = None) -> DataFrame:
    """``<keys>, chunk, n, values``: each key's values in order, in chunks ``0, 1, ...`` of at most ``chunk`` values.

    Laid one after another the chunks of a key are its whole list.  ``skip_nulls`` leaves null
    values out; an empty table gives no rows.
    """
    if chunk < 1:
        raise SpecError("a chunk holds at least one value")
    keys = list(keys)
    if clash := {"chunk", "n", "values"} & set(keys):
        raise SpecError(f"key names are taken: {', '.join(sorted(clash))}")
    v = src_col(value) if isinstance(value, str) else value
    rows = df.withColumn("_value", v)
    if all(isinstance(c, str) for c in order_by):  # nothing else is read
        rows = rows.select(*[src_col(c) for c in dict.fromkeys([*keys, *order_by])], "_value")
    if skip_nulls:
        rows = rows.filter(F.col("_value").isNotNull())
    placed = places(rows, keys, order_by, partitions)
    item = F.struct(F.col("_place").alias("p"), F.col("_value").alias("v"))
    return (placed.withColumn("chunk", F.expr(f"_place div {chunk}")).groupBy(*[src_col(k) for k in keys], "chunk")
            .agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("values")))
