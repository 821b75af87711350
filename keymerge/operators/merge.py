"""Keyed merge: N sources, a key, and a policy per destination field.

Plan shape (default, ``plan="auto"``)::

    for each joined source S:   scan(pruned cols) -> [filter non-null keys]
                                -> groupBy(keys).agg(partials of S, count(*))   # partial+final, map-side combine
    join the aggregated sources USING keys (how = inner | left | full)           # 1:1, co-partitioned on keys
    select keys, finish(policy) for every destination field

The aggregated sides are unique on the key and hash-partitioned on it, so the
join needs no further exchange of them; a key that holds a third of a source
is collapsed map-side into one partial row per task.  In ``fanout="rows"``
mode the finishers multiply by the other sources' row counts so the result is
the same as grouping the row-level join (what the original engine computes),
without building that join.  Only list-valued or custom policies over several
sources need the row-level join (``needs_rows``); they are computed on it and
joined back 1:1 by key.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping as TMapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policies import ORD, Ctx, PolicyExpr, n_col, ord_col, qual, src_col
from ..sources.readers import ordinal_expr
from ..spec import TYPE_NAMES, Mapping, MergeSpec, Policy, SourceField, SpecError, validate

HOWS = ("inner", "left", "full")
NUMERIC_POLICIES = ("sum", "average", "row_sum", "row_means")
_NUM_SUFFIX = "__num"


def numeric_inputs(sources: TMapping[str, DataFrame], mappings: list[Mapping]):
    """Text columns under a numeric policy are read through ``try_cast(double)``.

    A value that is not a number then counts as null (and is listed by
    ``quality.unresolved`` as a type mismatch) instead of failing the job.
    """
    todo: dict[str, set[str]] = {}
    for m in mappings:
        if m.policy.kind in NUMERIC_POLICIES:
            for f in m.fields:
                df = sources.get(f.source)
                if df is not None and f.column in df.columns and dict(df.dtypes)[f.column] == "string":
                    todo.setdefault(f.source, set()).add(f.column)
    if not todo:
        return sources, mappings
    out = dict(sources)
    for s, cols in todo.items():
        out[s] = out[s].withColumns({c + _NUM_SUFFIX: src_col(c).try_cast("double") for c in sorted(cols)})
    new_maps = []
    for m in mappings:
        if m.policy.kind in NUMERIC_POLICIES:
            flds = tuple(SourceField(f.source, f.column + _NUM_SUFFIX) if f.column in todo.get(f.source, ()) else f
                         for f in m.fields)
            m = Mapping(m.destination, m.policy, flds)
        new_maps.append(m)
    return out, new_maps
_ORDER_POLICIES = ("firstMatch", "lastMatch", "first_row", "row_means", "values", "coalesced_values", "concat", "custom")


def _passthrough_mappings(spec: MergeSpec, sources: TMapping[str, DataFrame], joined: list[str]) -> list[Mapping]:
    """destination fields without a mapping take the same-named source column (first row)."""
    mapped = {m.destination for m in spec.mappings}
    out = []
    for d in spec.destination:
        if d.name in mapped:
            continue
        owners = [s for s in joined if d.name in sources[s].columns]
        if len(owners) != 1:
            raise SpecError(f"Destination field {d.name} has no mapping and "
                            f"{'no' if not owners else 'more than one'} source column of that name")
        out.append(Mapping(d.name, Policy("first_row"), (SourceField(owners[0], d.name),)))
    return out


def key_text(c: Column, dtype: str) -> Column:
    """A key as text that equal keys of any type share: 1, 1.0 and "1" are one key."""
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        whole = c.try_cast("bigint")
        return F.when(c == whole.cast(dtype), whole.cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def mixed_keys(sources: TMapping[str, DataFrame], keycols: TMapping[str, dict[str, str]]) -> set[str]:
    """Keys that are text in one source and something else in another: they are compared as text.
    (Spark would read the text as numbers and fail at the first that is none.)"""
    kinds: dict[str, set[str]] = {}
    for s, cols in keycols.items():
        types = dict(sources[s].dtypes)
        for k, c in cols.items():
            kinds.setdefault(k, set()).add(types.get(c, "string"))
    return {k for k, t in kinds.items() if len(t) > 1 and "string" in t}


def prepare_source(df: DataFrame, source: str, keycols: dict[str, str], fields: list[SourceField],
                   need_ord: bool, order_by=None, drop_null_keys: bool = True, as_text: set[str] = frozenset()) -> DataFrame:
    """Project one source to ``keys (dest names) + [_ord] + qualified mapped columns``.

    Projection happens first so Catalyst prunes the scan to exactly these
    columns; the ordinal is attached on the scan, before any shuffle.
    """
    types = dict(df.dtypes)
    cols: list[Column] = [(key_text(src_col(c), types[c]) if k in as_text else src_col(c)).alias(k) for k, c in keycols.items()]
    if need_ord:
        # A source limited to some keys brings its order along, from before that join.
        cols.append(F.col(ORD) if ORD in df.columns else ordinal_expr(order_by, df).alias(ORD))
    seen = set()
    for f in fields:
        if f.source == source and f.column not in seen:
            seen.add(f.column)
            if f.column not in df.columns:
                raise SpecError(f"Source {source} has no column {f.column}")
            cols.append(src_col(f.column).alias(qual(source, f.column)))
    if drop_null_keys:
        # Filter before the ordinal is attached: a filter above a nondeterministic
        # projection is not pushed to the scan.  Row order among kept rows is unchanged.
        df = df.filter(reduce(lambda a, b: a & b, [src_col(c).isNotNull() for c in keycols.values()]))
    return df.select(*cols)


def _links_rows(spec: MergeSpec) -> bool:
    keys = spec.key_mappings()
    return len(keys) > 1 or any(len({f.source for f in m.fields}) < len(m.fields) for m in keys)


def merge(sources: TMapping[str, DataFrame], spec: MergeSpec, how: str = "inner", fanout: str = "rows",
          dedupe: bool = True, order_by: TMapping[str, object] | None = None, cast: bool = False,
          plan: str = "auto", keep_order: bool = False, ids: TMapping[str, str] | None = None,
          max_cluster_size: int | None = None, oversize: str = "rows") -> DataFrame:
    """Merge ``sources`` by ``spec``.  Returns one row per key (``dedupe=True``).

    * ``how``: ``inner`` (default), ``left`` (keep every key of the primary
      source), ``full`` (keys of any joined source).
    * ``fanout``: ``rows`` - values are counted once per row of the joined
      group, as in a row-level join; ``safe`` - each source row counts once.
    * ``order_by``: per-source row order for first/last/list policies; by
      default the scan order of each source.
    * ``plan``: ``auto`` (pre-aggregate, row join only where needed) or
      ``rowjoin`` (group the row-level join; the reference plan for tests).
    * ``keep_order``: sort the result by first appearance (a global sort, so
      use it for output only).
    * ``ids`` / ``max_cluster_size``: OR-key merges only (``spec.logic='or'``):
      per-source unique id columns for stable entity ids, and the cluster bound;
      ``oversize`` is ``rows`` or ``split`` (see ``entities.resolve``).
    """
    if how not in HOWS:
        raise SpecError(f"how must be one of {HOWS}")
    if fanout not in ("rows", "safe"):
        raise SpecError("fanout must be 'rows' or 'safe'")
    validate(spec, list(sources))
    for opt, given in (("order_by", order_by), ("ids", ids)):
        unknown = sorted(set(given or {}) - set(sources))
        if unknown:
            raise SpecError(f"{opt} names unknown sources: {', '.join(unknown)}")
    # With one key, fed by one column of each source, "any key" and "all keys" are the same.
    if spec.logic == "or" and _links_rows(spec):
        from .entities import or_key_merge

        if (how, fanout, dedupe, plan, keep_order) != ("inner", "rows", True, "auto", False):
            raise SpecError("an OR-key merge keeps every row and counts it once: how, fanout, dedupe, plan and keep_order do not apply")
        return or_key_merge(sources, spec, order_by=order_by, cast=cast, ids=ids, max_cluster_size=max_cluster_size, oversize=oversize)
    order_by = dict(order_by or {})
    joined = spec.joined_sources()
    keycols = spec.key_columns()
    keys = list(spec.keys)
    mappings = spec.value_mappings() + _passthrough_mappings(spec, sources, joined)
    as_text = mixed_keys(sources, {s: keycols[s] for s in joined})
    sources, mappings = numeric_inputs(sources, mappings)
    fields = [f for m in mappings for f in m.fields]
    pols = [PolicyExpr(m, i) for i, m in enumerate(mappings)]
    ctx = Ctx(joined, fanout)
    drop_nulls = len(joined) > 1

    if not dedupe:
        out = _row_join(sources, joined, keycols, fields, order_by, how, drop_nulls, need_ord=False, as_text=as_text)
        out = out.select(*keys, *[p.row_value() for p in pols])
        return _project(out, spec, keys, mappings, cast)

    row_pols = pols if plan == "rowjoin" else [p for p in pols if p.needs_rows(ctx)]
    agg_pols = [] if plan == "rowjoin" else [p for p in pols if p not in row_pols]
    # Only sources feeding an order-dependent policy carry a row ordinal (keeps their scans lean).
    ord_sources = set(joined) if keep_order else {f.source for p in pols if p.kind in _ORDER_POLICIES
                                                  for f in p.fields}

    parts: list[DataFrame] = []
    if agg_pols or not row_pols:
        aggs = []
        for s in joined:
            prep = prepare_source(sources[s], s, keycols[s], [f for p in agg_pols for f in p.fields] if agg_pols else [],
                                  s in ord_sources, order_by.get(s), drop_nulls, as_text)
            cols = [F.count(F.lit(1)).alias(n_col(s))]
            if keep_order:
                cols.append(F.min(ORD).alias(ord_col(s)))
            for p in agg_pols:
                cols += p.partials(s)
            aggs.append(prep.groupBy(*keys).agg(*cols))
        j = _combine(aggs, keys, how)
        sel = [F.col(k) for k in keys] + [p.finish(ctx) for p in agg_pols]
        if keep_order:
            sel.append(_first_seen(joined).alias("_first_seen"))
        parts.append(j.select(*sel))
    if row_pols:
        rows = _row_join(sources, joined, keycols, [f for p in row_pols for f in p.fields], order_by, how, drop_nulls,
                         need_ord=True, as_text=as_text)
        rorder = F.struct(*[F.col(ord_col(s)) for s in joined])
        sel = [p.row_agg(rorder) for p in row_pols]
        if keep_order and not parts:
            sel.append(F.min(_first_seen_row(joined)).alias("_first_seen"))
        parts.append(rows.groupBy(*keys).agg(*sel))
    out = reduce(lambda a, b: a.join(b, keys, "inner"), parts)
    out = _project(out, spec, keys, mappings, cast, keep_order)
    return out


def _combine(aggs: list[DataFrame], keys: list[str], how: str) -> DataFrame:
    """Join the per-source aggregates (each unique on the key and hash-partitioned by it).

    Inner and left joins keep that partitioning, so a chain of them needs no
    further exchange.  A full outer join does not: Spark re-shuffles its output
    before the next join.  For three or more sources the full merge is
    therefore a union of the aggregates plus one group-by on the key; the
    union keeps the shared partitioning, and every partial column comes from
    exactly one source row per key, so ``max`` picks it back out unchanged.
    """
    if how != "full" or len(aggs) < 3:
        return reduce(lambda a, b: a.join(b, keys, how), aggs)
    cols = [c for a in aggs for c in a.columns if c not in keys]
    types = {f.name: f.dataType for a in aggs for f in a.schema.fields}
    if any(isinstance(types[c], (T.MapType, T.VariantType)) for c in cols):  # not orderable: keep the joins
        return reduce(lambda a, b: a.join(b, keys, how), aggs)
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aggs)
    return u.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def _seen(joined: list[str], present: list[Column]) -> Column:
    """First source that has the key, then the row order in that source (orders of sources may differ in type)."""
    first = F.coalesce(*[F.when(p.isNotNull(), F.lit(i)) for i, p in enumerate(present)])
    return F.struct(first.alias("s"), *[F.when(first == i, F.col(ord_col(s))).alias(f"o{i}") for i, s in enumerate(joined)])


def _first_seen(joined: list[str]) -> Column:
    return _seen(joined, [F.col(n_col(s)) for s in joined])


def _first_seen_row(joined: list[str]) -> Column:
    return _seen(joined, [F.col(ord_col(s)) for s in joined])


def _row_join(sources, joined, keycols, fields, order_by, how, drop_nulls, need_ord, as_text=frozenset()) -> DataFrame:
    """Row-level join of the prepared sources (head semantics; fans out on many-to-many keys)."""
    preps = []
    for s in joined:
        p = prepare_source(sources[s], s, keycols[s], fields, need_ord, order_by.get(s), drop_nulls, as_text)
        if need_ord:
            p = p.withColumnRenamed(ORD, ord_col(s))
        preps.append(p)
    keys = list(keycols[joined[0]])
    return reduce(lambda a, b: a.join(b, keys, how), preps)


def _project(df: DataFrame, spec: MergeSpec, keys: list[str], mappings: list[Mapping], cast: bool,
             keep_order: bool = False) -> DataFrame:
    """destination columns in destination order; optional declared-type cast."""
    names = [d.name for d in spec.destination] or (keys + [m.destination for m in mappings])
    types = {d.name: d.data_type for d in spec.destination}
    cols = []
    for n in names:
        c = F.col(n)
        if cast and n in types:
            t = TYPE_NAMES.get(types[n])
            if t is None:
                raise SpecError(f"Unknown data type {types[n]} for {n}")
            c = c.try_cast(t).alias(n)
        cols.append(c)
    if keep_order:
        return df.orderBy("_first_seen").select(*cols)
    return df.select(*cols)
