"""Merge policies as Spark aggregate expressions.

Each policy is expressed twice:

* ``partials`` + ``finish`` - the *pre-aggregated* form.  ``partials`` are
  aggregate Columns evaluated per source, grouped by the key (so Spark does a
  map-side partial aggregate before the shuffle), and ``finish`` combines the
  per-source results after the 1:1 join of the aggregated sources.  In
  ``fanout="rows"`` mode the per-source results are scaled by the row counts of
  the other sources, which reproduces exactly what grouping the row-level join
  would give, without ever materialising that join.
* ``row_agg`` - the same policy as one aggregate over the row-level join.  It is
  used only where a policy needs whole joined rows (lists over several
  sources, custom aggregates over several sources) and as the reference plan in
  the tests.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import Mapping, SourceField

ORD = "_ord"


def safe_name(text: str) -> str:
    """An identifier-safe internal name (messy headers may hold dots, spaces, quotes)."""
    clean = re.sub(r"[^0-9A-Za-z_]", "_", text)
    if clean == text:
        return text
    return f"{clean}_{zlib.crc32(text.encode()):08x}"


def src_col(name: str) -> Column:
    """Reference a source column by its literal name (dots are not struct access)."""
    return F.col("`" + name.replace("`", "``") + "`")


def qual(source: str, column: str) -> str:
    """Qualified name of a source column after projection (no collisions across sources)."""
    return safe_name(f"{source}__{column}")


def n_col(source: str) -> str:
    return safe_name(f"_n__{source}")


def ord_col(source: str) -> str:
    return safe_name(f"{ORD}__{source}")


def _sum_cols(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _prod(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, cols) if cols else F.lit(1)


def least(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def greatest(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def ordered_list(value: Column, order: Column, own: Column | None = None) -> Column:
    """Values of a group ordered by ``order`` (nulls kept: the struct is never null).  ``own``
    limits them to the rows where it holds."""
    pair = F.struct(order.alias("o"), value.alias("v"))
    pairs = F.array_sort(F.collect_list(pair if own is None else F.when(own, pair)))
    return F.transform(pairs, lambda x: x["v"])


def _non_null_list(value: Column, order: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


@dataclass
class Ctx:
    """What a policy needs to know about the join it is finished over."""

    joined: list[str]
    fanout: str = "rows"

    def present(self, s: str) -> Column:
        return F.coalesce(F.col(n_col(s)), F.lit(0))

    def m(self, s: str) -> Column:
        """Rows that source ``s`` contributes to each joined row group (absent -> 1 null row)."""
        return F.greatest(self.present(s), F.lit(1))

    def mult(self, sources: set[str] | str) -> Column | None:
        """Fan-out factor for a value of ``sources``: rows of every *other* joined source (None = 1)."""
        own = {sources} if isinstance(sources, str) else set(sources)
        others = [t for t in self.joined if t not in own]
        if self.fanout != "rows" or not others:
            return None
        return _prod([self.m(t) for t in others])

    def scaled(self, c: Column, sources: set[str] | str) -> Column:
        m = self.mult(sources)
        return c if m is None else c * m


def _fans(ctx: Ctx) -> bool:
    return ctx.fanout == "rows" and len(ctx.joined) > 1


def _fan(lst: Column, source: str, ctx: Ctx) -> Column:
    """The list one source contributes to its key's joined rows, in row-join order.

    Joined rows enumerate (row of S1, row of S2, ...) lexicographically, so
    each element of source Si's list appears ``prod(m_j, j > i)`` times in a
    row, and the whole list repeats ``prod(m_j, j < i)`` times.  Absent
    sources count as one null row.  Equals grouping the row join without
    building it.
    """
    if not _fans(ctx):
        return lst
    i = ctx.joined.index(source)
    inner = _prod([ctx.m(t) for t in ctx.joined[i + 1:]]).cast("int")
    outer = _prod([ctx.m(t) for t in ctx.joined[:i]]).cast("int")
    rep = F.flatten(F.transform(lst, lambda x: F.array_repeat(x, inner))) if ctx.joined[i + 1:] else lst
    return F.flatten(F.array_repeat(rep, outer)) if ctx.joined[:i] else rep


def _by_source(fields: list[SourceField]) -> dict[str, list[SourceField]]:
    out: dict[str, list[SourceField]] = {}
    for f in fields:
        out.setdefault(f.source, []).append(f)
    return out


class PolicyExpr:
    """Expressions for one mapping.  ``mi`` makes partial names unique."""

    def __init__(self, mapping: Mapping, mi: int):
        self.m = mapping
        self.kind = mapping.policy.kind
        self.mi = mi
        self.fields = mapping.ordered_fields()
        self.listed = list(mapping.fields)

    # names ------------------------------------------------------------------
    def p(self, tag: str, i: int | str) -> str:
        return f"_p{self.mi}_{tag}_{i}"

    def sources(self) -> list[str]:
        out: list[str] = []
        for f in self.fields:
            if f.source not in out:
                out.append(f.source)
        return out

    def needs_rows(self, ctx: Ctx) -> bool:
        """True when the policy can only be computed over whole joined rows."""
        multi_src = len(self.sources()) > 1
        fanned = ctx.fanout == "rows" and len(ctx.joined) > 1
        if self.kind == "custom":
            return multi_src or fanned
        if self.kind in ("row_means", "coalesced_values"):
            return multi_src
        return False  # values / concat: per-source lists are expanded by the fan-out (``_fan``)

    # pre-aggregated form -------------------------------------------------------
    def partials(self, source: str) -> list[Column]:
        k = self.kind
        out: list[Column] = []
        for i, f in enumerate(self.fields):
            if f.source != source:
                continue
            v = F.col(qual(f.source, f.column))
            if k == "firstMatch":
                out.append(F.min_by(v, F.when(v.isNotNull(), F.col(ORD))).alias(self.p("first", i)))
            elif k == "lastMatch":
                out.append(F.max_by(v, F.when(v.isNotNull(), F.col(ORD))).alias(self.p("last", i)))
            elif k in ("sum", "average"):
                out.append(F.sum(v).alias(self.p("sum", i)))
                if k == "average":
                    out.append(F.count(v).alias(self.p("cnt", i)))
            elif k == "count":
                out.append(F.count(v).alias(self.p("cnt", i)))
            elif k == "min":
                out.append(F.min(v).alias(self.p("min", i)))
            elif k == "max":
                out.append(F.max(v).alias(self.p("max", i)))
            elif k == "concat":
                out.append(_non_null_list(v, F.col(ORD)).alias(self.p("list", i)))
        if k == "first_row" and self.listed[0].source == source:
            f0 = self.listed[0]
            out.append(F.min_by(F.col(qual(f0.source, f0.column)), F.col(ORD)).alias(self.p("first_row", 0)))
        if k == "row_sum":
            own = _by_source(self.fields).get(source)
            if own:
                rv = _sum_cols([F.col(qual(f.source, f.column)) for f in own])
                out += [F.sum(rv).alias(self.p("rsum", source)), F.count(rv).alias(self.p("rcnt", source))]
        whole_source = self.sources() == [source]
        if k == "values" and self.listed[0].source == source:
            f0 = self.listed[0]
            out.append(ordered_list(F.col(qual(f0.source, f0.column)), F.col(ORD)).alias(self.p("one", 0)))
        elif k in ("row_means", "coalesced_values", "custom") and whole_source:
            cols = [F.col(qual(f.source, f.column)) for f in self.listed]
            out.append(self._row_list_or_custom(cols, F.col(ORD)).alias(self.p("one", 0)))
        return out

    def _row_list_or_custom(self, cols: list[Column], order: Column, own: Column | None = None) -> Column:
        k = self.kind
        if k == "row_means":
            return ordered_list(_sum_cols(cols).cast("double") / F.lit(len(cols)), order, own)
        if k == "values":
            return ordered_list(cols[0], order, own)
        if k == "coalesced_values":
            return ordered_list(F.coalesce(*cols) if len(cols) > 1 else cols[0], order, own)
        return self.m.policy.func(*cols)

    def finish(self, ctx: Ctx) -> Column:
        k = self.kind
        fs = self.fields
        name = self.m.destination
        if k == "firstMatch":
            e = F.coalesce(*[F.col(self.p("first", i)) for i in range(len(fs))]) if len(fs) > 1 else F.col(self.p("first", 0))
        elif k == "lastMatch":
            e = F.coalesce(*[F.col(self.p("last", i)) for i in range(len(fs))]) if len(fs) > 1 else F.col(self.p("last", 0))
        elif k == "first_row":
            e = F.col(self.p("first_row", 0))
        elif k == "sum":
            e = _sum_cols([F.coalesce(ctx.scaled(F.col(self.p("sum", i)), f.source), F.lit(0)) for i, f in enumerate(fs)])
        elif k == "count":
            e = _sum_cols([F.coalesce(ctx.scaled(F.col(self.p("cnt", i)), f.source), F.lit(0)) for i, f in enumerate(fs)])
        elif k == "count_rows":
            if ctx.fanout == "rows":
                e = _prod([ctx.m(s) for s in ctx.joined])
            else:
                e = _sum_cols([ctx.present(s) for s in self.sources()])
        elif k == "average":
            num = _sum_cols([F.coalesce(ctx.scaled(F.col(self.p("sum", i)), f.source), F.lit(0)) for i, f in enumerate(fs)])
            den = _sum_cols([F.coalesce(ctx.scaled(F.col(self.p("cnt", i)), f.source), F.lit(0)) for i, f in enumerate(fs)])
            e = num.cast("double") / F.when(den != 0, den)
        elif k == "min":
            e = least([F.col(self.p("min", i)) for i in range(len(fs))])
        elif k == "max":
            e = greatest([F.col(self.p("max", i)) for i in range(len(fs))])
        elif k == "row_sum":
            srcs = list(_by_source(fs))
            terms = []
            for s in srcs:
                t = F.col(self.p("rsum", s))
                if ctx.fanout == "rows":
                    for o in srcs:
                        if o != s:
                            t = t * F.coalesce(F.col(self.p("rcnt", o)), F.lit(0))
                    t = ctx.scaled(t, set(srcs))
                terms.append(F.coalesce(t, F.lit(0)))
            e = _sum_cols(terms)
        elif k == "concat":
            lists = [_fan(F.coalesce(F.col(self.p("list", i)), F.array()), f.source, ctx) for i, f in enumerate(fs)]
            arr = F.concat(*lists) if len(lists) > 1 else lists[0]
            e = F.when(F.size(arr) > 0, F.array_join(arr.cast("array<string>"), self.m.policy.sep))
        elif k in ("values", "row_means", "coalesced_values"):
            lst = F.col(self.p("one", 0))
            src = self.listed[0].source
            e = _fan(F.coalesce(lst, F.array(F.lit(None))), src, ctx) if _fans(ctx) else lst
        elif k == "custom":
            e = F.col(self.p("one", 0))
        else:  # pragma: no cover - Policy validates kinds
            raise ValueError(k)
        return e.alias(name)

    # row-level form ------------------------------------------------------------
    def row_agg(self, row_order: Column, own: Column | None = None) -> Column:
        """One aggregate over the row-level join (``rows`` semantics).

        ``own``: where the rows are a union of sources, the condition for a row of this
        policy's source; policies that look at whole rows see only those."""
        k = self.kind
        fs = self.fields
        vals = [F.col(qual(f.source, f.column)) for f in fs]
        name = self.m.destination
        if k == "firstMatch":
            e = F.coalesce(*[F.min_by(v, F.when(v.isNotNull(), F.col(ord_col(f.source)))) for v, f in zip(vals, fs)]) \
                if len(fs) > 1 else F.min_by(vals[0], F.when(vals[0].isNotNull(), F.col(ord_col(fs[0].source))))
        elif k == "lastMatch":
            e = F.coalesce(*[F.max_by(v, F.when(v.isNotNull(), F.col(ord_col(f.source)))) for v, f in zip(vals, fs)]) \
                if len(fs) > 1 else F.max_by(vals[0], F.when(vals[0].isNotNull(), F.col(ord_col(fs[0].source))))
        elif k == "first_row":
            f0 = self.listed[0]
            e = F.min_by(F.col(qual(f0.source, f0.column)), row_order if own is None else F.when(own, row_order))
        elif k == "sum":
            e = _sum_cols([F.coalesce(F.sum(v), F.lit(0)) for v in vals])
        elif k == "count":
            e = _sum_cols([F.count(v) for v in vals])
        elif k == "count_rows":
            e = F.count(F.lit(1))
        elif k == "average":
            num = _sum_cols([F.coalesce(F.sum(v), F.lit(0)) for v in vals])
            den = _sum_cols([F.count(v) for v in vals])
            e = num.cast("double") / F.when(den != 0, den)
        elif k == "min":
            e = least([F.min(v) for v in vals])
        elif k == "max":
            e = greatest([F.max(v) for v in vals])
        elif k == "row_sum":
            e = F.coalesce(F.sum(_sum_cols(vals)), F.lit(0))
        elif k == "concat":
            arr = F.concat(*[_non_null_list(v, row_order) for v in vals]) if len(vals) > 1 else _non_null_list(vals[0], row_order)
            e = F.when(F.size(arr) > 0, F.array_join(arr.cast("array<string>"), self.m.policy.sep))
        else:
            lcols = [F.col(qual(f.source, f.column)) for f in self.listed]
            e = self._row_list_or_custom(lcols, row_order, own)
        return e.alias(name)

    def row_value(self) -> Column:
        """Value for an ungrouped merge (``dedupe=False``): the policy over the fields of one row."""
        from ..spec import SpecError

        vals, k = [F.col(qual(f.source, f.column)) for f in self.fields], self.kind
        known = _sum_cols([v.isNotNull().cast("bigint") for v in vals])
        total = _sum_cols([F.coalesce(v, F.lit(0)) for v in vals]) if k in ("sum", "average") else None
        if k in ("firstMatch", "lastMatch"):
            e = F.coalesce(*vals)
        elif k == "first_row":
            e = F.col(qual(self.listed[0].source, self.listed[0].column))
        elif k == "sum":
            e = total
        elif k == "average":
            e = total.cast("double") / F.when(known != 0, known)
        elif k == "count":
            e = known
        elif k == "count_rows":
            e = F.lit(1).cast("bigint")
        elif k == "row_sum":
            e = F.coalesce(_sum_cols(vals), F.lit(0))
        elif k in ("min", "max"):
            e = (least if k == "min" else greatest)(vals)
        else:
            raise SpecError(f"policy {k} needs grouped rows; it does not apply with dedupe=False")
        return e.alias(self.m.destination)


def custom(func: Callable[..., Column]):
    """Build a custom policy: ``func(*field_columns) -> aggregate Column``."""
    from ..spec import Policy

    return Policy("custom", func=func)
