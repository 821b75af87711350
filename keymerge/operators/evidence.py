"""Why rows are one entity (Q5): the links from each row to its entity's first row.

Every row but the first of its entity gets a parent that it is linked with directly, one step
nearer to the first row, and the link and value that join the two.  Following parents gives a
shortest path of links.  Entities of up to ``LOCAL_LINKS`` links are searched in one
task each; larger ones step by step from their first rows outwards, all of them at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from typing import Mapping as TMapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code, written
from ..spec import SourceField, SpecError
from .entities import ENTITY, ROW_ID, Link, _build_nodes, _link_keys, _similar_pairs, _used_sources, components

#: Links of an entity that one task searches.
LOCAL_LINKS = 200_000


def link_edges(sources: TMapping[str, DataFrame], links: Sequence[Link] = (), key_fields: Sequence[Sequence[SourceField]] = (),
               ids: TMapping[str, str] | None = None) -> DataFrame:
    """The links between rows: ``src, dst, link, value``.

    Rows that share a value are linked to the first of them; ``link`` is the number of the link, or of
    the OR key after the links; ``value`` what they share, or ``a ~ b`` for two similar values.
    """
    used = _used_sources(links, key_fields)
    nodes = _build_nodes(sources, used, links, [], ids, None, [list(k) for k in key_fields])
    parts = []
    for i, lk in enumerate(links):
        keys = _link_keys(nodes, i, lk)
        if lk.kind != "fuzzy":
            parts.append(_stars(keys, i, both_sides=not lk.is_self()))
            continue
        pairs = written(_similar_pairs(keys, lk), "similar")
        both = pairs.select("block", F.col("a").alias("key")).unionByName(pairs.select("block", F.col("b").alias("key"))).distinct()
        held = keys.join(both, ["block", "key"], "left_semi")
        parts.append(_stars(held, i, both_sides=False))
        first = written(held.groupBy("block", "key").agg(F.min(ROW_ID).alias("first")), "firsts")
        near = (pairs.filter("a <> b").join(first.select("block", F.col("key").alias("a"), F.col("first").alias("src")), ["block", "a"])
                .join(first.select("block", F.col("key").alias("b"), F.col("first").alias("dst")), ["block", "b"]))
        parts.append(near.filter("src <> dst").select("src", "dst", F.lit(i).alias("link"), F.concat_ws(" ~ ", "a", "b").alias("value")))
    for k in range(len(key_fields)):
        keys = nodes.select(ROW_ID, F.lit("").alias("block"), F.explode(f"_kk{k}").alias("key"), F.lit(2).alias("side")).filter(F.col("key").isNotNull())
        parts.append(_stars(keys, len(links) + k, both_sides=False))
    if not parts:
        raise SpecError("there are no links to explain")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _stars(keys: DataFrame, link: int, both_sides: bool) -> DataFrame:
    first = keys.groupBy("block", "key").agg(F.min(ROW_ID).alias("dst"), F.min("side").alias("low"), F.max("side").alias("high"))
    if both_sides:
        first = first.filter("low = 0 and high >= 1")
    # Written first: both sides of the join then have an exchange, and AQE can split a hot value.
    first = written(first.select("block", "key", "dst"), "stars")
    return (keys.join(first, ["block", "key"]).filter(F.col(ROW_ID) != F.col("dst"))
            .select(F.col(ROW_ID).alias("src"), "dst", F.lit(link).alias("link"), F.col("key").alias("value")))


def _search(steps: pa.Table) -> pa.Table:
    """All rows of one entity: parents by breadth-first search; of several parents the smallest, then link and value."""
    near = defaultdict(list)
    for x, y, link, value in zip(*(steps.column(c).to_pylist() for c in ("x", "y", "link", "value")), strict=True):
        near[x].append((y, link, value))
    entity = steps.column("component")[0].as_py()
    found, frontier, depth, out = {entity}, [entity], 0, []
    while frontier:
        depth += 1
        best = {}
        for x in frontier:
            for y, link, value in near[x]:
                if y not in found and (y not in best or (x, link, value) < best[y]):
                    best[y] = x, link, value
        frontier = list(best)
        found.update(best)
        out += [(entity, y, x, link, value, depth) for y, (x, link, value) in best.items()]
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = [steps.schema.field("x").type] * 3 + [pa.int32(), pa.string(), pa.int32()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[ENTITY, ROW_ID, "parent", "link", "value", "depth"])


def link_paths(edges: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``entity_id, _row_id, parent, link, value, depth`` for every row but the first of each entity.

    ``edges`` are those of ``link_edges``; the entity is named by its smallest row.  ``depth`` is the
    least number of links to the first row; of several parents the smallest counts, then the least link
    and value.  Rows without links are not in the result.
    """
    ship_code(edges.sparkSession)
    edges = written(edges.filter("src <> dst").select("src", "dst", "link", "value").distinct(), "edges")
    member = written(components(edges).select(F.col("node").alias("x"), "component"), "members")
    ways = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), "link", "value").unionByName(
        edges.select(F.col("dst").alias("x"), F.col("src").alias("y"), "link", "value"))
    ways = written(ways.join(member, "x"), "ways")
    large = written(ways.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * local_links).select("component"), "large")
    kind = ways.schema["x"].dataType.simpleString()
    schema = f"{ENTITY} {kind}, {ROW_ID} {kind}, parent {kind}, link int, value string, depth int"
    out = ways.join(large, "component", "left_anti").groupBy("component").applyInArrow(_search, schema)
    if large.isEmpty():
        return out
    ways = written(ways.join(large, "component", "left_semi"), "large_ways")
    found = frontier = large.select(F.col("component").alias(ROW_ID))
    parts, depth = [out], 0
    while True:
        depth += 1
        step = (ways.join(frontier.select(F.col(ROW_ID).alias("x")), "x").groupBy("component", "y")
                .agg(F.min(F.struct("x", "link", "value")).alias("by")).withColumnRenamed("y", ROW_ID).join(found.select(ROW_ID), ROW_ID, "left_anti"))
        step = written(step.select(F.col("component").alias(ENTITY), ROW_ID, F.col("by.x").alias("parent"), F.col("by.link").alias("link"),
                                   F.col("by.value").alias("value"), F.lit(depth).alias("depth")), "step")
        if step.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), parts)
        parts.append(step)
        frontier = step.select(ROW_ID)
        found = written(found.select(ROW_ID).unionByName(frontier), "found")


def explain_entities(sources: TMapping[str, DataFrame], links: Sequence[Link] = (), key_fields: Sequence[Sequence[SourceField]] = (),
                     ids: TMapping[str, str] | None = None) -> DataFrame:
    """``link_paths`` of the links and OR keys between ``sources``; row ids are those of ``resolve`` with the same ``ids``."""
    return link_paths(link_edges(sources, links, key_fields, ids))
