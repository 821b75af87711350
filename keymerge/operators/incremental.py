"""Incremental re-merge (I1): recompute only the keys a source change touches.

A keyed merge is independent per key, so after a change

    result' = (prev  left_anti  changed_keys)  UNION  merge(sources'  left_semi  changed_keys)

equals a full merge of the new sources.  ``changed_keys`` are the distinct keys
of the rows that differ between the old and new version of the changed
source(s) (or of a change feed supplied by the caller).  The semi/anti joins
shuffle only on the key; the changed-key set grows with the change, not with
the data, is written once, and AQE broadcasts it only when it is measured small.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping as TMapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policies import src_col
from ..session import materialize
from ..sources.readers import ORD, with_ordinal
from ..spec import MergeSpec, SpecError
from .entities import ENTITY, ROW_ID, _build_nodes, _used_sources, _value_star_edges, components, merge_nodes, or_columns, or_plan
from .merge import merge, numeric_inputs


def changed_keys(spec: MergeSpec, source: str, old: DataFrame | None = None, new: DataFrame | None = None,
                 changes: DataFrame | None = None, order_by=None) -> DataFrame:
    """Distinct destination keys touched by a change of ``source``.

    Either ``changes`` (rows inserted, deleted or updated, old and new images)
    or both versions ``old`` and ``new`` of the source are given.  In the latter
    case rows are counted by the columns that the merge reads (keys, mapped and
    order columns): a row that one version holds more often than the other is a
    change.  A column that only one version has makes every row a change.
    """
    kc = spec.key_columns()[source]
    if changes is None:
        if old is None or new is None:
            raise SpecError("changed_keys needs changes, or old and new")
        read = set(kc.values()) | {f.column for m in spec.mappings for f in m.fields if f.source == source}
        read |= {d.name for d in spec.destination} - {m.destination for m in spec.mappings}
        read |= {c for c in (order_by if isinstance(order_by, (list, tuple)) else [order_by]) if isinstance(c, str)}
        both = sorted(read & set(old.columns) & set(new.columns))
        alone = read & (set(old.columns) ^ set(new.columns))
        side = [df.select(*[src_col(c) for c in both], F.lit(n).alias("_n")) for df, n in ((old, 1), (new, -1))]
        changes = side[0].unionByName(side[1])
        if not alone:
            changes = changes.groupBy(*[src_col(c) for c in both]).agg(F.sum("_n").alias("_n")).filter("_n != 0")
    return changes.select(*[src_col(c).alias(k) for k, c in kc.items()]).distinct()


def limit_to_keys(sources: TMapping[str, DataFrame], spec: MergeSpec, keys: DataFrame, order_by=None) -> dict[str, DataFrame]:
    """Each keyed source's rows whose key is in ``keys`` (null keys included).

    The row order is attached first, on the scan: after the join it would be another one.
    ``keys`` should be written already, so that hot keys of a source can be split by AQE.
    """
    kc = spec.key_columns()
    out = dict(sources)
    for s in set(sources) & set(kc):
        df = with_ordinal(sources[s], (order_by or {}).get(s))
        out[s] = _join_keys(df, keys, kc[s], "left_semi")
    return out


def _join_keys(df: DataFrame, keys: DataFrame, columns: dict[str, str], how: str) -> DataFrame:
    """Semi or anti join to ``keys``; ``columns`` names the key columns of ``df``; nulls equal nulls."""
    right = keys.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(columns)])
    same = [src_col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(columns.values())]
    return df.join(right, reduce(lambda a, b: a & b, same), how)


def remerge_changed(prev: DataFrame, sources: TMapping[str, DataFrame], spec: MergeSpec, keys: DataFrame,
                    **merge_kw) -> DataFrame:
    """Replace the rows of ``prev`` whose key is in ``keys`` by a fresh merge of just those keys."""
    if spec.logic == "or":
        raise SpecError("OR-key merges link rows across keys: use or_state and remerge_or")
    keys = materialize(keys, "changed")
    fresh = merge(limit_to_keys(sources, spec, keys, merge_kw.get("order_by")), spec, **merge_kw)
    kept = _join_keys(prev, keys, {k: k for k in spec.keys}, "left_anti")
    return kept.unionByName(fresh.select(*prev.columns))


def remerge(prev: DataFrame, old_sources: TMapping[str, DataFrame], new_sources: TMapping[str, DataFrame],
            spec: MergeSpec, changed: list[str] | None = None, **merge_kw) -> DataFrame:
    """I1 end to end: find the changed keys of the ``changed`` sources and re-merge them."""
    changed = changed or [s for s in new_sources if new_sources[s] is not old_sources.get(s)]
    order_by = merge_kw.get("order_by") or {}
    ks = [changed_keys(spec, s, old_sources[s], new_sources[s], order_by=order_by.get(s)) for s in changed if s in spec.key_columns()]
    if not ks:
        return prev
    keys = reduce(lambda a, b: a.unionByName(b), ks).distinct()
    return remerge_changed(prev, new_sources, spec, keys, **merge_kw)


# ------------------------------------------------------------------ OR keys
def or_state(sources: TMapping[str, DataFrame], spec: MergeSpec, ids: TMapping[str, str]) -> DataFrame:
    """What ``remerge_or`` keeps of an OR-key merge: ``_row_id, entity_id, keys``, a row per source row.

    ``keys`` are the row's key values with the number of their key.  Every value belongs to
    one entity, so the table is also the map from values to entities.  Store it beside the result.
    """
    from .entities import resolve

    key_fields, used = _or_sources(sources, spec, ids)
    nodes = resolve(sources, [], [], ids=ids, key_fields=key_fields)
    return nodes.select(ROW_ID, ENTITY, _held_keys(nodes, key_fields).alias("keys"))


def _or_sources(sources, spec: MergeSpec, ids) -> tuple[list, list[str]]:
    if spec.logic != "or":
        raise SpecError("only an OR-key merge has a state of links")
    key_fields = or_plan(sources, spec)[0]
    used = _used_sources([], key_fields)
    if missing := [s for s in used if s not in (ids or {})]:
        raise SpecError(f"rows are known by their ids: ids is missing {', '.join(missing)}")
    return key_fields, used


def _held_keys(nodes: DataFrame, key_fields: list):
    """A row's key values as ``array<struct<ki, key>>``, without nulls."""
    def numbered(ki: int):
        return lambda k: F.struct(F.lit(ki).alias("ki"), k.alias("key"))

    parts = [F.transform(F.filter(F.coalesce(F.col(f"_kk{ki}"), F.array().cast("array<string>")), lambda k: k.isNotNull()), numbered(ki))
             for ki in range(len(key_fields)) if f"_kk{ki}" in nodes.columns]
    return F.array_distinct(F.concat(*parts))


def changed_ids(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Ids of the rows that two versions of a source do not share, by comparing whole rows (a feed of changes needs no such pass)."""
    columns = sorted(set(old.columns) & set(new.columns))
    side = [df.select(*[src_col(c) for c in columns], F.lit(n).alias("_n")) for df, n in ((old, 1), (new, -1))]
    both = side[0].unionByName(side[1]).groupBy(*[src_col(c) for c in columns]).agg(F.sum("_n").alias("_n")).filter("_n != 0")
    return both.select(src_col(id_col)).distinct()


def remerge_or(prev: DataFrame, state: DataFrame, sources: TMapping[str, DataFrame], spec: MergeSpec, changes: TMapping[str, DataFrame],
               ids: TMapping[str, str], order_by: TMapping[str, object] | None = None, cast: bool = False) -> tuple[DataFrame, DataFrame]:
    """I1 for OR keys: the new result and the new state after rows of ``sources`` changed.

    ``prev`` is the result of the OR-key merge with ``ids``, ``state`` its ``or_state``; ``changes`` has, per
    source, a table whose column named like the source's id column holds the ids of rows inserted,
    updated or deleted since; ``sources`` are the new versions.

    Entities that lost a row, or a row's old keys, are taken apart and linked anew from their rows'
    stored keys.  All others stay whole: an entity that a new value meets takes part as one
    node, its smallest row.  Components run over these nodes only, and of the sources only the
    rows of entities that changed are merged; the rest of ``prev`` and ``state`` is kept as it is.
    """
    key_fields, used = _or_sources(sources, spec, ids)
    n = len(used)
    touched = []
    for s, ch in changes.items():
        if s in used:
            touched.append(ch.select((src_col(ids[s]).cast("bigint") * F.lit(n) + F.lit(used.index(s))).alias(ROW_ID)))
    if not touched:
        return prev, state
    changed = materialize(reduce(lambda a, b: a.unionByName(b), touched).distinct())
    # Rows as they are now, only the changed ones.
    images = materialize(_nodes_of(sources, used, changed, key_fields, [], ids, order_by)
                         .transform(lambda d: d.select(ROW_ID, _held_keys(d, key_fields).alias("keys"))))
    broken = materialize(state.join(changed, ROW_ID, "left_semi").select(ENTITY).distinct())
    loose = materialize(state.join(broken, ENTITY, "left_semi").join(changed, ROW_ID, "left_anti").select(ROW_ID, "keys"))
    # Whole entities that hold a value of the loose or new rows (loose rows' values are only held by broken entities).
    values = materialize(_values(images).select("ki", "key").distinct())
    met = materialize(_values(state.join(broken, ENTITY, "left_anti")).join(values, ["ki", "key"], "left_semi")
                      .select(F.col(ENTITY).alias(ROW_ID), "ki", "key").distinct())
    moving = images.unionByName(loose)
    nodes = _values(moving).select(ROW_ID, "ki", "key").unionByName(met)
    keyed = nodes.select(ROW_ID, F.struct("ki", "key").alias("key"), F.lit(2).alias("side"))
    root = components(_value_star_edges(keyed, require_both_sides=False)).select(F.col("node").alias(ROW_ID), F.col("component").alias("_root"))
    root = materialize(root)
    whole = materialize(met.select(ROW_ID).distinct().join(root, ROW_ID, "left").select(F.col(ROW_ID).alias(ENTITY), F.coalesce("_root", ROW_ID).alias("_root")))
    rows = moving.join(root, ROW_ID, "left").select(ROW_ID, F.coalesce("_root", ROW_ID).alias(ENTITY), "keys")
    joined = state.join(whole, ENTITY).select(ROW_ID, F.col("_root").alias(ENTITY), "keys")
    fresh_state = materialize(rows.unionByName(joined))
    gone = broken.unionByName(whole.select(ENTITY))
    kept_state = state.join(gone, ENTITY, "left_anti").select(ROW_ID, ENTITY, "keys")
    # Merge the rows of the entities that are new or changed.
    _, maps = or_plan(sources, spec)
    inputs, maps = numeric_inputs(sources, maps)
    members = _nodes_of(inputs, used, fresh_state.select(ROW_ID), key_fields, [f for m in maps for f in m.fields], ids, order_by)
    merged = merge_nodes(members.join(fresh_state.select(ROW_ID, ENTITY), ROW_ID), maps, used, with_size=False)
    fresh = or_columns(merged, spec, maps, cast)
    return prev.join(gone, ENTITY, "left_anti").unionByName(fresh.select(*prev.columns)), kept_state.unionByName(fresh_state)


def _values(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_k", F.explode("keys")).select(*[c for c in rows.columns if c != "keys"], "_k.ki", "_k.key")


def _nodes_of(sources, used: list[str], row_ids: DataFrame, key_fields: list, fields: list, ids, order_by) -> DataFrame:
    """The nodes of the given rows; their order is taken on the scan, before the join to the ids."""
    own, order = {}, {}
    for i, s in enumerate(used):
        want = row_ids.filter(F.col(ROW_ID) % F.lit(len(used)) == i).select(F.expr(f"{ROW_ID} div {len(used)}").alias("_id"))
        df = with_ordinal(sources[s], (order_by or {}).get(s))
        own[s] = df.join(want, src_col(ids[s]).cast("bigint") == F.col("_id"), "left_semi")
        order[s] = ORD
    return _build_nodes(own, used, [], fields, ids, order, key_fields)
