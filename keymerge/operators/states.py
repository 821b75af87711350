"""Incremental merge by states that take changes back.

Beside the result of a keyed merge its per-key partial states are kept, one set of tables for
each source: row counts, sums and counts, which a signed change adds to or takes from; and
for first, last, least and greatest values the values themselves with their numbers,
so that the next one is known when the present one goes.  A change of a source then reads its
own rows (the change), the states of the keys that it touches, and the result; no
source is scanned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Mapping as TMapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policies import Ctx, PolicyExpr, n_col, qual, src_col
from ..session import materialize
from ..spec import MergeSpec, SourceField, SpecError
from .incremental import _join_keys
from .merge import HOWS, _combine, _passthrough_mappings, _project, mixed_keys, prepare_source

#: The sign column of a change: 1 for a row that came, -1 for one that went (an update is both).
SIGN = "_sign"

_ADDED = ("sum", "average", "count", "count_rows", "row_sum")
_KEPT = {"firstMatch": "first", "lastMatch": "last", "first_row": "first_row", "min": "min", "max": "max"}


class _Plan:
    """What the states of a spec hold."""

    def __init__(self, spec: MergeSpec, schemas: TMapping[str, DataFrame], order_by: TMapping[str, object] | None):
        if spec.logic == "or":
            raise SpecError("states are per key: for OR keys use or_state and remerge_or")
        self.spec, self.joined, self.keycols, self.keys = spec, spec.joined_sources(), spec.key_columns(), list(spec.keys)
        if mixed_keys(schemas, {s: self.keycols[s] for s in self.joined}):
            raise SpecError("keys must have the same type in all sources")
        self.mappings = spec.value_mappings() + _passthrough_mappings(spec, schemas, self.joined)
        self.pols = [PolicyExpr(m, i) for i, m in enumerate(self.mappings)]
        self.order = {s: [o] if isinstance(o, str) else list(o) for s, o in (order_by or {}).items()}
        for p in self.pols:
            if p.kind not in _ADDED and p.kind not in _KEPT:
                raise SpecError(f"policy {p.kind} has no state that takes changes back")
            for f in p.fields:
                kind = dict(schemas[f.source].dtypes)[f.column]
                if p.kind in ("sum", "average", "row_sum") and not (kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint")):
                    raise SpecError(f"{f.source}.{f.column} is {kind}: sums that are taken back must be exact (cast it to decimal)")
                if p.kind in ("firstMatch", "lastMatch", "first_row") and f.source not in self.order:
                    raise SpecError(f"policy {p.kind} needs order_by for {f.source}: changes have no scan order")

    def rows(self, source: str, changes: DataFrame) -> DataFrame:
        """Signed rows with destination keys and qualified columns, and the row order ``_o``."""
        fields = [f for p in self.pols for f in p.fields if f.source == source] + [SourceField(source, SIGN)]
        fields += [SourceField(source, c) for c in self.order.get(source, [])]
        out = prepare_source(changes, source, self.keycols[source], fields, False, None, len(self.joined) > 1)
        if source in self.order:
            out = out.withColumn("_o", F.struct(*[F.col(qual(source, c)).alias(f"k{i}") for i, c in enumerate(self.order[source])]))
        return out.withColumnRenamed(qual(source, SIGN), SIGN)

    def added(self, source: str) -> dict[str, Column]:
        """Per partial that adds up, what a row contributes."""
        out = {n_col(source): F.lit(1)}
        for p in self.pols:
            own = [(i, F.col(qual(f.source, f.column))) for i, f in enumerate(p.fields) if f.source == source]
            if p.kind == "row_sum" and own:
                total = reduce(lambda a, b: a + b, [v for _, v in own])
                out[p.p("rsum", source)], out[p.p("rcnt", source)] = total, total.isNotNull().cast("bigint")
            for i, v in own:
                if p.kind in ("sum", "average"):
                    out[p.p("sum", i)] = v
                if p.kind in ("count", "average"):
                    out[p.p("cnt", i)] = v.isNotNull().cast("bigint")
        return out

    def kept(self, source: str) -> dict[str, tuple[str, Column, Column | None]]:
        """Per partial that picks a value: the kind, the value, and its order where that decides."""
        out = {}
        for p in self.pols:
            if p.kind not in _KEPT:
                continue
            for i, f in enumerate([p.listed[0]] if p.kind == "first_row" else p.fields):
                if f.source == source:
                    ordered = p.kind in ("firstMatch", "lastMatch", "first_row")
                    out[p.p(_KEPT[p.kind], i)] = p.kind, F.col(qual(f.source, f.column)), F.col("_o") if ordered else None
        return out


def _same_keys(df: DataFrame, keys: list[str]) -> list[Column]:
    return [src_col(k) for k in keys]


def _summed(plan: _Plan, source: str, parts: Sequence[DataFrame]) -> DataFrame:
    names = list(plan.added(source))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    kinds = dict(parts[0].dtypes)
    return both.groupBy(*_same_keys(both, plan.keys)).agg(*[F.sum(n).cast(kinds[n]).alias(n) for n in names]).filter(F.col(n_col(source)) != 0)


def _counted(plan: _Plan, parts: Sequence[DataFrame]) -> DataFrame:
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy(*_same_keys(both, plan.keys), "o", "v").agg(F.sum("c").alias("c")).filter("c <> 0")


def _delta(plan: _Plan, source: str, changes: DataFrame) -> dict[str, DataFrame]:
    """The states of signed rows alone."""
    rows = plan.rows(source, changes)
    sums = [F.sum(F.coalesce(v, F.lit(0)) * F.col(SIGN)).alias(n) for n, v in plan.added(source).items()]
    out = {f"{source}/sums": rows.groupBy(*_same_keys(rows, plan.keys)).agg(*sums)}
    for name, (kind, v, order) in plan.kept(source).items():
        some = rows if kind == "first_row" else rows.filter(v.isNotNull())
        items = some.select(*_same_keys(rows, plan.keys), (F.lit(0) if order is None else order).alias("o"), v.alias("v"), F.col(SIGN).cast("bigint").alias("c"))
        out[f"{source}/{name}"] = _counted(plan, [items])
    return out


def merge_states(sources: TMapping[str, DataFrame], spec: MergeSpec, order_by: TMapping[str, object] | None = None) -> dict[str, DataFrame]:
    """The states of a keyed merge, by name; store each table beside the result.

    Policies: sum, count, average, count_rows, row_sum, min, max, firstMatch, lastMatch, first_row.
    Sums need whole or decimal numbers (fractions in binary would not come back exactly); first and
    last values need ``order_by`` columns, which should tell the rows of a key apart.
    """
    plan = _Plan(spec, sources, order_by)
    return {k: v for s in plan.joined for k, v in _delta(plan, s, sources[s].withColumn(SIGN, F.lit(1))).items()}


def finish_states(states: TMapping[str, DataFrame], schemas: TMapping[str, DataFrame], spec: MergeSpec, how: str = "inner", fanout: str = "rows",
                  order_by: TMapping[str, object] | None = None, keys: DataFrame | None = None, cast: bool = False) -> DataFrame:
    """The merge's result from its states, of all keys or of ``keys``.  ``schemas`` are the sources, of which only the schemas are used."""
    if how not in HOWS:
        raise SpecError(f"how must be one of {HOWS}")
    plan = _Plan(spec, schemas, order_by)

    def some(df: DataFrame) -> DataFrame:
        return df if keys is None else _join_keys(df, keys, {k: k for k in plan.keys}, "left_semi")

    aggs = []
    for s in plan.joined:
        parts = [some(states[f"{s}/sums"])]
        for name, (kind, _, _) in plan.kept(s).items():
            items = some(states[f"{s}/{name}"])
            pick = {"min": F.min("v"), "max": F.max("v"), "lastMatch": F.max_by("v", "o")}.get(kind, F.min_by("v", "o"))
            parts.append(items.groupBy(*_same_keys(items, plan.keys)).agg(pick.alias(name)))
        # Every state of a source has at most the keys of its counts; null keys (of a single source) equal each other.
        one = parts[0]
        for p in parts[1:]:
            right = p.select(*[src_col(k).alias(f"_k{i}") for i, k in enumerate(plan.keys)], *[c for c in p.columns if c not in plan.keys])
            on = reduce(lambda a, b: a & b, [src_col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(plan.keys)])
            one = one.join(right, on, "left").drop(*[f"_k{i}" for i in range(len(plan.keys))])
        aggs.append(one)
    ctx = Ctx(plan.joined, fanout)
    out = _combine(aggs, plan.keys, how).select(*_same_keys(aggs[0], plan.keys), *[p.finish(ctx) for p in plan.pols])
    return _project(out, spec, plan.keys, plan.mappings, cast)


def apply_changes(prev: DataFrame, states: TMapping[str, DataFrame], schemas: TMapping[str, DataFrame], spec: MergeSpec,
                  changes: TMapping[str, DataFrame], how: str = "inner", fanout: str = "rows", order_by: TMapping[str, object] | None = None,
                  cast: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The new result and states after signed ``changes`` (per source its rows with a column ``_sign``: 1 came, -1 went).

    ``prev`` and ``states`` are those of before; ``schemas`` are the sources, of which only the schemas are used.  Rows that
    go must be given as they were.  The result equals a merge of the new sources.
    """
    plan = _Plan(spec, schemas, order_by)
    new, touched = dict(states), []
    for s, ch in changes.items():
        if s not in plan.joined:
            continue
        for name, delta in _delta(plan, s, ch).items():
            delta = materialize(delta)
            if name.endswith("/sums"):
                touched.append(delta.select(*_same_keys(delta, plan.keys)))
                new[name] = materialize(_summed(plan, s, [states[name], delta.select(*states[name].columns)]))
            else:
                touched.append(delta.select(*_same_keys(delta, plan.keys)))
                new[name] = materialize(_counted(plan, [states[name], delta.select(*states[name].columns)]))
    if not touched:
        return prev, new
    keys = materialize(reduce(lambda a, b: a.unionByName(b), touched).distinct())
    fresh = finish_states(new, schemas, spec, how, fanout, order_by, keys, cast)
    kept = _join_keys(prev, keys, {k: k for k in plan.keys}, "left_anti")
    return kept.unionByName(fresh.select(*prev.columns)), new
