"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, shared_scratch

#: Rows of one Arrow batch at most: texts may be long, and a batch is held whole.
ARROW_ROWS = 512
#: Rows that a side may have for an explicit broadcast (beyond it: a shuffled join).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Select columns by exact name (``new=old``), ignoring all others.

    Works where extra columns clash with ours, also by letter case or by
    repetition (the first column of exactly that name counts).
    """
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(old)}").alias(new) for new, old in cols.items()])


def unclashed(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns ``names`` as they are and all others under names that nothing of
    ours has, and a function that brings the columns of ``df`` back under their own names."""
    own = df.columns
    first = {own.index(n) for n in names}
    plain = [n if i in first else f"_other{i}" for i, n in enumerate(own)]
    return df.toDF(*plain), lambda out: out.select(*plain).toDF(*own)


def prepare(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make Python tasks safe to start: bound the rows of an Arrow batch, so that long texts do
    not fill a worker, and send this package to the executors (once per context)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="keymerge-code-")  # the driver's own; Spark serves the file
        sc.addPyFile(shutil.make_archive(f"{folder}/{root.name}_code", "zip", root.parent, root.name))
        _sent.add(sc.applicationId)


_sent: set[str] = set()


def tidy() -> None:
    """Give memory that a Python task no longer needs back to the system: workers live on, several beside an
    executor's heap, and keep freed memory otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidied(run):
    """A task's function that tidies up when its batches are done."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


try:  # of the GNU C library alone
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None


def with_columns(df: DataFrame, input_col: str, schema: str, make) -> DataFrame:
    """All columns of ``df`` and new ones computed from the texts of one column.

    ``make()`` is called once per task and returns a function from a list of bytes (null:
    empty) to the arrays of the new columns, which ``schema`` names.
    """
    prepare(df.sparkSession)
    at, names = df.columns.index(input_col), df.columns
    added = [x.split()[0] for x in schema.split(",")]
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])

    def run(batches):
        f = make()
        for b in batches:
            new = f([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *added])

    out = StructType([*plain.schema.fields, *StructType.fromDDL(schema).fields])
    return plain.mapInArrow(tidied(run), out).toDF(*names, *added)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir`` and read it
    back: lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = shared_scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a stored table if its counted rows are few; else leave it to a
    shuffled join.  Either way the result is the same."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
