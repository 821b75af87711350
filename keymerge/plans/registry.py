"""Query registry and helpers shared by the query modules.

Every query reads the driver's parquet tables (or data Spark derives from
them) in full, and comes with the equivalent DuckDB SQL where one exists.
Money is summed as DECIMAL(18,2) and cast to DOUBLE at the end, averages are
``CAST(sum AS DOUBLE) / count`` on both sides, so value hashes are exact.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import Mapping, Policy, SourceField

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def M(dest: str, policy: str | Policy, *fields: tuple[str, str], **kw) -> Mapping:
    pol = policy if isinstance(policy, Policy) else Policy(policy, **kw)
    return Mapping(dest, pol, tuple(SourceField(s, c) for s, c in fields))


DEC = "decimal(18,2)"


def _orders_dec(spark, sf):
    return table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast(DEC))


def _to_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


