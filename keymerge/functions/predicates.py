"""Predicates (F2-F9) as small composable objects that compile to Spark Columns.

Values arrive as strings (as in a JSON plan); each predicate resolves its
column's type from the DataFrame it is applied to, so ``Equals("qty", "5")``
compares numbers and ``Equals("name", "5")`` compares text.  Everything
compiles to built-in expressions, so filters stay inside whole-stage codegen
and simple comparisons are pushed down to the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policies import src_col


class Pred:
    def to_column(self, df: DataFrame) -> Column:  # pragma: no cover - abstract
        raise NotImplementedError

    def __and__(self, other: "Pred") -> "Pred":
        return And(self, other)

    def __or__(self, other: "Pred") -> "Pred":
        return Or(self, other)

    def __invert__(self) -> "Pred":
        return Not(self)


def _dtype(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


@dataclass(frozen=True)
class Equals(Pred):
    column: str
    value: str

    def to_column(self, df):
        t = _dtype(df, self.column)
        lit = F.lit(self.value) if t == "string" else F.lit(self.value).try_cast(t)
        return src_col(self.column) == lit


@dataclass(frozen=True)
class Contains(Pred):
    column: str
    value: str

    def to_column(self, df):
        return src_col(self.column).cast("string").contains(self.value)


@dataclass(frozen=True)
class Regex(Pred):
    column: str
    pattern: str

    def to_column(self, df):
        return src_col(self.column).cast("string").rlike(self.pattern)


@dataclass(frozen=True)
class IsNull(Pred):
    """Null or empty text."""

    column: str

    def to_column(self, df):
        c = src_col(self.column)
        if _dtype(df, self.column) == "string":
            return c.isNull() | (c == F.lit(""))
        return c.isNull()


@dataclass(frozen=True)
class IsNotNull(Pred):
    column: str

    def to_column(self, df):
        return ~IsNull(self.column).to_column(df)


@dataclass(frozen=True)
class GreaterThan(Pred):
    column: str
    value: str

    def to_column(self, df):
        return _numeric(df, self.column) > F.lit(float(self.value))


@dataclass(frozen=True)
class LessThan(Pred):
    column: str
    value: str

    def to_column(self, df):
        return _numeric(df, self.column) < F.lit(float(self.value))


def _numeric(df: DataFrame, c: str) -> Column:
    t = _dtype(df, c)
    if t in ("double", "float", "bigint", "int", "smallint", "tinyint") or t.startswith("decimal"):
        return src_col(c)  # native comparison: pushed down to the scan
    return src_col(c).try_cast("double")


@dataclass(frozen=True)
class And(Pred):
    left: Pred
    right: Pred

    def to_column(self, df):
        return self.left.to_column(df) & self.right.to_column(df)


@dataclass(frozen=True)
class Or(Pred):
    left: Pred
    right: Pred

    def to_column(self, df):
        return self.left.to_column(df) | self.right.to_column(df)


@dataclass(frozen=True)
class Not(Pred):
    inner: Pred

    def to_column(self, df):
        return ~self.inner.to_column(df)


@dataclass(frozen=True)
class Expr(Pred):
    """a SQL boolean expression, e.g. ``status = 'active'``."""

    sql: str

    def to_column(self, df):
        return F.expr(self.sql)


def all_of(*preds: Pred) -> Pred:
    return reduce(And, preds)


def any_of(*preds: Pred) -> Pred:
    return reduce(Or, preds)


def filter_rows(df: DataFrame, pred: Pred | str) -> DataFrame:
    """Apply a predicate (or SQL text, F3)."""
    p = Expr(pred) if isinstance(pred, str) else pred
    return df.filter(p.to_column(df))


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """keep ``columns`` in the given order."""
    return df.select(*columns)


def from_dict(d: dict) -> Pred:
    """Build a predicate from a plan fragment such as ``{"GreaterThan": {"column": "x", "value": "3"}}``."""
    (kind, body), = d.items()
    simple = {"Equals": Equals, "Contains": Contains, "Regex": Regex, "GreaterThan": GreaterThan, "LessThan": LessThan}
    if kind in simple:
        val = body.get("value", body.get("pattern"))
        return simple[kind](body["column"], val)
    if kind in ("IsNull", "IsNotNull"):
        return (IsNull if kind == "IsNull" else IsNotNull)(body["column"] if isinstance(body, dict) else body)
    if kind in ("And", "Or"):
        items = [from_dict(x) for x in ((body["left"], body["right"]) if isinstance(body, dict) else body)]
        return reduce(And if kind == "And" else Or, items)
    if kind == "Not":
        return Not(from_dict(body.get("predicate", body)))
    if kind in ("Expr", "Sql"):
        return Expr(body)
    raise ValueError(f"Unknown predicate: {kind}")
