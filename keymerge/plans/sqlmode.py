"""SQL mode (J-SQL): free-form Spark SQL over the named sources.

Each source id becomes a temporary view, so ``SELECT ... FROM customers JOIN
orders ...`` works as written; Catalyst plans it like any DataFrame query.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..spec import validate_sql


def sql(sources: Mapping[str, DataFrame], text: str, spark: SparkSession | None = None) -> DataFrame:
    """Run ``text`` with every source registered under its id."""
    validate_sql(text)
    if spark is None:
        if not sources:
            raise ValueError("sql() needs at least one source or an explicit session")
        spark = next(iter(sources.values())).sparkSession
    # Views are analysed with the query; afterwards the session's own ones are as before.
    own = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    before = {sid: spark.table(_quoted(sid)) for sid in sources if sid.lower() in own}
    try:
        for sid, df in sources.items():
            df.createOrReplaceTempView(_quoted(sid))
        return spark.sql(text)
    finally:
        for sid in sources:
            if sid in before:
                before[sid].createOrReplaceTempView(_quoted(sid))
            else:
                spark.catalog.dropTempView(sid)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
