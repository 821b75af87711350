"""Data quality and lineage (Q1-Q6).

* ``unresolved`` (Q1-Q3): one report of keys without a partner, empty mapped
  fields and values that do not fit a numeric policy - per-key counts combined
  once across all sources plus filters on the executors, aggregated per key
  before anything is unioned.
* ``unresolved_entities`` (Q4): rows of clusters above the size bound.
* ``lineage`` (Q5): every source value behind every merged value, as a long
  table (one row per considered value) - never a list collected per key.
* ``coverage`` (Q6): which destination fields use each source column, with
  per-column row and non-null counts from one aggregate per source.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping as TMapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policies import src_col
from ..sources.readers import ordinal_expr
from ..spec import MergeSpec, validate

_NUMERIC_POLICIES = ("sum", "average", "row_sum", "row_means")
_NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _key_select(spec: MergeSpec, source: str) -> list[Column]:
    return [src_col(c).alias(k) for k, c in spec.key_columns()[source].items()]


def _report(df: DataFrame, keys: list[str], source: str, field: Column, reason: Column) -> DataFrame:
    return df.select(F.lit(source).alias("source"), *keys, field.cast("string").alias("field"),
                     reason.alias("reason"), F.col("n_rows"))


def unresolved(sources: TMapping[str, DataFrame], spec: MergeSpec) -> DataFrame:
    """``(source, <keys>, field, reason, n_rows)`` for records the merge cannot resolve cleanly.

    * ``no match in <T>``: a key of source S with no row in joined source T (Q1);
    * ``null key``: rows whose key is null, with two or more joined sources (C15);
    * ``empty field``: mapped value null or empty text (Q2);
    * ``type mismatch``: text that is not a number under a numeric policy (Q3).
    """
    validate(spec, list(sources))
    keys = list(spec.keys)
    joined = spec.joined_sources()
    parts: list[DataFrame] = []
    keyed = {s: sources[s].select(*_key_select(spec, s)) for s in joined}
    not_null = {s: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) for s in joined}
    per_key = {s: keyed[s].filter(not_null[s]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")) for s in joined}
    if len(joined) > 1:
        # One full combination of the per-key counts (all hash-partitioned on the key)
        # answers every (source, partner) pair in one pass.
        from .merge import _combine

        counts = [per_key[s].withColumnRenamed("n_rows", f"_n{i}") for i, s in enumerate(joined)]
        allk = _combine(counts, keys, "full")
        misses = [F.when(F.col(f"_n{i}").isNotNull() & F.col(f"_n{j}").isNull(),
                         F.struct(F.lit(s).alias("source"), F.lit(f"no match in {t}").alias("reason"),
                                  F.col(f"_n{i}").alias("n_rows")))
                  for i, s in enumerate(joined) for j, t in enumerate(joined) if i != j]
        miss = allk.select(*keys, F.explode(F.filter(F.array(*misses), lambda x: x.isNotNull())).alias("_m"))
        parts.append(miss.select(F.col("_m.source").alias("source"), *keys, F.lit(None).cast("string").alias("field"),
                                 F.col("_m.reason").alias("reason"), F.col("_m.n_rows").alias("n_rows")))
        for s in joined:
            nulls = keyed[s].filter(~not_null[s]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            parts.append(_report(nulls, keys, s, F.lit(None), F.lit("null key")))
    # One scan per source: each row lists what is wrong with its mapped fields.
    for s in {f.source: None for m in spec.value_mappings() for f in m.fields}:
        kinds, found = dict(sources[s].dtypes), {}
        for m, f in [(m, f) for m in spec.value_mappings() for f in m.fields if f.source == s]:
            v, kind, name = src_col(f.column), kinds[f.column], f"{s}.{f.column}"
            empty = (v.isNull() | (v == F.lit(""))) if kind == "string" else v.isNull()
            found[name, "empty field", m.destination] = empty
            if m.policy.kind in _NUMERIC_POLICIES and kind not in _NUMERIC_TYPES and not kind.startswith("decimal"):
                text = v.cast("string")
                found[name, "type mismatch", m.destination] = text.isNotNull() & (text != F.lit("")) & text.try_cast("double").isNull()
        wrong = [F.when(bad, F.struct(F.lit(name).alias("field"), F.lit(reason).alias("reason"), F.lit(dest).alias("dest")))
                 for (name, reason, dest), bad in found.items()]
        rows = sources[s].select(*_key_select(spec, s), F.explode(F.array_compact(F.array(*wrong))).alias("_w"))
        rows = rows.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(rows.select(F.lit(s).alias("source"), *keys, F.col("_w.field").alias("field"), F.col("_w.reason").alias("reason"), "n_rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def unresolved_entities(resolved: DataFrame) -> DataFrame:
    """Q4: rows left unmerged because their cluster exceeded ``max_cluster_size``."""
    from .entities import ROW_ID, SRC

    over = resolved.filter(F.col("_oversize"))
    return over.select(SRC, ROW_ID, F.col("_cluster").alias("cluster_id"), F.lit("cluster too large").alias("reason"))


def lineage(sources: TMapping[str, DataFrame], spec: MergeSpec, merged: DataFrame | None = None,
            order_by: TMapping[str, object] | None = None, how: str = "inner", **merge_kw) -> DataFrame:
    """Q5: ``(<keys>, field, source, column, row_order, value, merged)``, one row per value considered.

    ``merged`` is the merge result (computed with ``merge`` when omitted); its
    values are unpivoted per field and joined back by key and field, so the
    report is as distributed as the merge itself.
    """
    from .merge import merge

    order_by = dict(order_by or {})
    if merged is None:
        merged = merge(sources, spec, how=how, order_by=order_by, **merge_kw)
    keys = list(spec.keys)
    vm = spec.value_mappings()
    long_merged = merged.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m.destination).alias("field"), F.col(m.destination).cast("string").alias("merged"))
        for m in vm])).alias("_m")).select(*keys, "_m.field", "_m.merged")
    parts = []
    for s in {f.source: None for m in vm for f in m.fields}:  # one scan per source
        df = sources[s]
        values = F.array(*[F.struct(F.lit(m.destination).alias("field"), F.lit(f.column).alias("column"), src_col(f.column).cast("string").alias("value"))
                           for m in vm for f in m.fields if f.source == s])
        by = order_by.get(s)
        order = ordinal_expr(by, df) if by is None or isinstance(by, (list, tuple)) else src_col(by) if isinstance(by, str) else by
        rows = df.select(*_key_select(spec, s), order.cast("string").alias("row_order"), F.explode(values).alias("_v"))
        parts.append(rows.select(*keys, "_v.field", F.lit(s).alias("source"), "_v.column", "row_order", "_v.value"))
    considered = reduce(lambda a, b: a.unionByName(b), parts)
    # Null keys form a group where there is one source; they equal each other here.
    right = long_merged.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("field").alias("_field"), "merged")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)] + [F.col("field") == F.col("_field")]
    out = considered.join(right, reduce(lambda a, b: a & b, same))
    return out.select(*keys, "field", "source", "column", "row_order", "value", "merged")


def coverage(sources: TMapping[str, DataFrame], spec: MergeSpec) -> DataFrame:
    """Q6: ``(source, column, used_by, n_fields, present, n_rows, n_values)``.

    ``used_by`` lists the destination fields fed by the column (sorted, comma
    separated).  ``present`` is false for a mapped column the source does not
    have (a schema mismatch; its ``n_values`` is null).  Counts come from one
    aggregate per source.
    """
    spark = next(iter(sources.values())).sparkSession
    uses: dict[tuple[str, str], set[str]] = {}
    for m in spec.mappings:
        for f in m.fields:
            uses.setdefault((f.source, f.column), set()).add(m.destination)
    rows = [(s, c, ",".join(sorted(d)), len(d)) for (s, c), d in uses.items()]
    spec_df = spark.createDataFrame(rows, "source string, column string, used_by string, n_fields int")
    counts = []
    for s in sorted({s for s, _ in uses}):
        cols = sorted({c for (src, c) in uses if src == s})
        have = set(sources[s].columns)
        agg = sources[s].agg(F.count(F.lit(1)).alias("n_rows"),
                             *[(F.count(src_col(c)) if c in have else F.lit(None).cast("bigint")).alias(f"_n_{i}")
                               for i, c in enumerate(cols)])
        counts.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(s).alias("source"), F.lit(c).alias("column"), F.lit(c in have).alias("present"),
                     F.col("n_rows"), F.col(f"_n_{i}").alias("n_values"))
            for i, c in enumerate(cols)])).alias("_c")).select("_c.*"))
    return spec_df.join(reduce(lambda a, b: a.unionByName(b), counts), ["source", "column"])
