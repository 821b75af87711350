"""Sinks (S9-S11) and previews.

Writes are distributed (one file per task under a directory); nothing is
collected on the driver.  Previews return DataFrames so the limit reaches the
plan (``CollectLimit`` / ``TakeOrderedAndProject``) instead of collecting
everything first.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import Column, DataFrame

from ..spec import SpecError, msg

WRITE_FORMATS = ("csv", "tsv", "parquet", "orc", "json")


def write(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", partition_by: list[str] | None = None,
          order_by: list[str | Column] | None = None) -> None:
    """Write ``df`` to ``path`` in ``fmt``.

    ``order_by`` applies a global sort only here, at the sink, which is the one
    place where row order is observable.
    """
    f = (fmt or "").strip().lower()
    if f not in WRITE_FORMATS:
        raise SpecError(msg("unsupported_format", fmt))
    if order_by:
        df = df.orderBy(*order_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if f in ("csv", "tsv"):
        w.option("header", True).option("sep", "\t" if f == "tsv" else ",").option("escape", "\"").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        getattr(w, f)(path)


def preview(df: DataFrame, n: int | None = 50, offset: int = 0, order_by: list[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows (S12), or the page ``[offset, offset+n)``.

    Pages need a total order to be meaningful, so ``offset`` requires
    ``order_by``.
    """
    if offset and not order_by:
        raise SpecError("a paged preview needs order_by")
    if order_by:
        df = df.orderBy(*order_by)
    if offset:
        df = df.offset(offset)
    if n is not None:
        df = df.limit(n)
    return df


def preview_text(df: DataFrame, n: int = 50) -> str:
    """Render the first ``n`` rows as a table string (the CLI preview)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.show(n, truncate=40)
    return buf.getvalue()
