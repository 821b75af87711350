"""Pages of a result by a stored index.

An offset sorts the result and throws away all rows before the page.  ``write_pages`` sorts once:
the rows go into range partitions, each in a folder of its own, with the number of rows before it.
A page then reads the one or two folders that its rows are in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.policies import src_col
from ..session import materialize
from ..spec import SpecError


def write_pages(df: DataFrame, path: str, order_by: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """Write ``df`` under ``path`` in the given order and return the index: ``part, before, n``, a row per range.

    ``order_by`` should order all rows (add a unique column): rows of equal order are numbered as written.
    """
    if taken := {"part", "_at"} & set(df.columns):
        raise SpecError(f"column names are taken: {', '.join(sorted(taken))}")
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [src_col(c) if isinstance(c, str) else c for c in order_by]
    number = F.monotonically_increasing_id()
    rows = df.repartitionByRange(p, *by).sortWithinPartitions(*by).withColumns(
        {"_at": number.bitwiseAND(F.lit((1 << 33) - 1)), "part": F.shiftright(number, 33).cast("int")})
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    counts = materialize(spark.read.parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, page: int, size: int) -> DataFrame:
    """Rows ``page * size`` to ``(page + 1) * size`` of a result that ``write_pages`` wrote, with ``_row`` (from 0); read them by it.

    Only the folders that hold them are read; a page beyond the last is empty.
    """
    if page < 0 or size < 1:
        raise SpecError("pages are numbered from 0 and hold at least one row")
    low, high = page * size, (page + 1) * size
    # The index has a row per range; a page lies in few of them.
    parts = spark.read.parquet(f"{path}/index").filter((F.col("before") < high) & (F.col("before") + F.col("n") > low)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.filter(F.col("part").isin([r.part for r in parts])) if parts else rows.limit(0)
    start = F.element_at(F.create_map(*[F.lit(x) for r in parts for x in (r.part, r.before)]), F.col("part")) if parts else F.lit(0)
    at = (start + F.col("_at")).cast("bigint")
    return rows.withColumn("_row", at).filter((F.col("_row") >= low) & (F.col("_row") < high)).drop("part", "_at")
