"""Semantic value types (T5) as a ladder of regular expressions.

Fixed values: the patterns below define the types; the first match wins,
null or empty gives null.  They are plain Java regexes evaluated by ``rlike``
inside whole-stage codegen (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semantic type ladder, in evaluation order.
SEMANTIC_LADDER: list[tuple[str, str]] = [
    ("boolean", r"^(?i:true|false)$"),
    ("email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
    ("datetime", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("integer", r"^-?[0-9]+$"),
    ("float", r"^-?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"),
    ("currency", r"^-?[$€£] ?[0-9][0-9,]*(\.[0-9]+)?$"),
    ("postcode", r"^([A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}|[A-Z][0-9][A-Z] [0-9][A-Z][0-9]|[0-9]{5}-[0-9]{4})$"),
    ("phone", r"^(\+[0-9]|\([0-9]|[0-9])[0-9 ().-]{5,}[0-9]( x[0-9]+)?$"),
    ("country_code", r"^[A-Z]{2}$"),
    ("name", r"^[A-Z][a-z'-]+( [A-Z][a-z'-]+){0,3}$"),
]
TEXT = "text"
SEMANTIC_TYPES = [t for t, _ in SEMANTIC_LADDER] + [TEXT]

# Storage-type inference rungs (bool -> bigint -> double -> string).
INFER_RUNGS: list[tuple[str, str]] = [
    ("boolean", r"^(?i:true|false)$"),
    ("bigint", r"^-?[0-9]+$"),
    ("double", r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
]
DATE_RUNGS: list[tuple[str, str]] = [
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"),
]


def semantic_type(c: Column | str) -> Column:
    """Semantic type of each value as a string column (null for null/empty)."""
    v = F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c
    v = v.cast("string")
    expr = F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
    for name, pat in SEMANTIC_LADDER:
        expr = expr.when(v.rlike(pat), F.lit(name))
    return expr.otherwise(F.lit(TEXT))

