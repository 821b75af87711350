"""Clusters of bounded size from weighted links.

The clusters are those of a union-find that takes the links one after another, the
strongest first, and refuses every union above the bound; links of equal weight follow
the order of their ends.  Three facts let Spark decide many links at once with the same
result:

* A component within the bound is one cluster: no union in it can be refused.
* Clusters only grow, so a link between clusters already too large together is refused now.
* Let each cluster pick its strongest link.  The picks form trees, in which links get
  stronger towards the root.  The strongest links of a tree join clusters around its root;
  as long as these are within the bound together and no link to another tree is stronger
  than the weakest of them, the sequential order would join them before anything else
  could reach them.

Components with few links are then taken link by link, each in one task; larger ones go
through rounds of the third kind until what is left of them is small or empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import exchanged, ship_code, written
from .entities import components

#: Links of a component that one task takes.
LOCAL_LINKS = 200_000


def _strength(weight: str, a: str, b: str) -> Column:
    """Orders links: the least is the strongest."""
    return F.struct((-F.col(weight).cast("double")).alias("w"), F.col(a).alias("p"), F.col(b).alias("q"))


def _sequential(bound: int):
    """The links of one component, in order: ``label -> cluster`` (its smallest label)."""

    def run(links: pa.Table) -> pa.Table:
        order = links.sort_by([("w", "ascending"), ("p", "ascending"), ("q", "ascending")])
        a, b = order["a"].to_pylist(), order["b"].to_pylist()
        size = dict(zip(a, order["sa"].to_pylist(), strict=True)) | dict(zip(b, order["sb"].to_pylist(), strict=True))
        parent = {x: x for x in size}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(a, b, strict=True):
            x, y = root(x), root(y)
            if x != y and size[x] + size[y] <= bound:
                x, y = min(x, y), max(x, y)
                parent[y] = x
                size[x] += size[y]
        return pa.table({"label": pa.array(parent, order.schema.field("a").type), "cluster": pa.array([root(x) for x in parent], order.schema.field("a").type)})

    return run


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("x"), F.col("b").alias("y"), "k").unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"), "k"))


def _round(links: DataFrame, sizes: DataFrame, bound: int) -> DataFrame:
    """One round: ``label -> cluster`` of the clusters that change.  ``links`` are ``a, b, k`` between clusters
    within the bound together; ``sizes`` has the ``label`` and ``size`` of each."""
    ways = _both_ways(links)
    pick = written(ways.groupBy("x").agg(F.min(F.struct("k", "y")).alias("m")).select("x", F.col("m.k").alias("k"), F.col("m.y").alias("y")))
    tree = written(components(pick, "x", "y").withColumnRenamed("component", "tree"))
    leaving = (ways.join(exchanged(tree.select(F.col("node").alias("x"), F.col("tree").alias("tx"))), "x")
               .join(exchanged(tree.select(F.col("node").alias("y"), F.col("tree").alias("ty"))), "y")
               .filter("tx <> ty").groupBy("x").agg(F.min("k").alias("leaving")))
    rows = (pick.select("x", "k").join(exchanged(tree.select(F.col("node").alias("x"), "tree")), "x")
            .join(exchanged(sizes.select(F.col("label").alias("x"), "size")), "x").join(exchanged(leaving), "x", "left"))
    # From the root outwards.  The two clusters at the root picked the same link; each further one adds its own.
    outwards = Window.partitionBy("tree").orderBy("k", "x")
    near = outwards.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.row_number().over(outwards)).filter(F.col("place") <= bound)
    fits = (F.col("place") > 1) & (F.sum("size").over(near) <= bound)
    free = F.coalesce(F.col("k") < F.min("leaving").over(near), F.lit(True))
    rows = rows.withColumn("last", F.max(F.when(fits & free, F.col("place"))).over(Window.partitionBy("tree"))).filter(F.col("place") <= F.col("last"))
    return rows.select(F.col("x").alias("label"), F.min("x").over(Window.partitionBy("tree")).alias("cluster"))


def _relabelled(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    return (df.join(exchanged(to.select(F.col("label").alias(column), F.col("cluster").alias("_to"))), column, "left")
            .withColumn(column, F.coalesce("_to", column)).drop("_to"))


def bounded_components(edges: DataFrame, bound: int, src: str = "src", dst: str = "dst", weight: str = "weight",
                       local_links: int = LOCAL_LINKS) -> DataFrame:
    """``node, component, split``: clusters of at most ``bound`` nodes, named by their smallest node.

    The result is that of taking all links by falling ``weight`` (then by their smaller and larger end)
    and joining the two clusters of each if they have at most ``bound`` nodes together.  Of
    several links between two nodes the strongest counts; links of a node to itself only make it
    a node of the result.  ``split`` is true where the node's connected component is above the bound.
    """
    if bound < 1:
        raise ValueError("the bound must be at least 1")
    ship_code(edges.sparkSession)
    links = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), weight)
    alone = links.filter("a = b").select(F.col("a").alias("node")).distinct()
    links = written(links.filter("a <> b").groupBy("a", "b").agg(F.max(weight).alias(weight)))
    whole = written(components(links, "a", "b"))
    count = written(whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    whole = whole.join(exchanged(count), "component").select("node", "component", (F.col("n") > bound).alias("split"))
    large = written(whole.filter("split").select("node", "component"))
    # Links of the components above the bound, between clusters that are single nodes at first.
    todo = links.join(exchanged(large.select(F.col("node").alias("a"), F.col("component").alias("group"))), "a").select(
        "a", "b", _strength(weight, "a", "b").alias("k"), "group")
    label = large.select("node", F.col("node").alias("label"))
    sizes = label.select("label", F.lit(1).cast("long").alias("size"))
    while True:
        small = {s: exchanged(sizes.select(F.col("label").alias(s), F.col("size").alias(f"s{s}"))) for s in "ab"}
        todo = written(todo.join(small["a"], "a").join(small["b"], "b").filter(F.col("sa") + F.col("sb") <= bound))
        if todo.isEmpty():
            break
        # Components of few links are settled now, each in one task.
        few = exchanged(written(todo.groupBy("group").agg(F.count(F.lit(1)).alias("n"))).filter(F.col("n") <= local_links).select("group"))
        kind = todo.schema["a"].dataType.simpleString()
        settled = written(todo.join(few, "group", "left_semi").select("group", "a", "b", "sa", "sb", "k.*").groupBy("group")
                              .applyInArrow(_sequential(bound), f"label {kind}, cluster {kind}"))
        rest = todo.join(few, "group", "left_anti").select("a", "b", "k")
        moved = settled
        if more := not rest.isEmpty():
            rest = written(rest)
            moved = written(settled.unionByName(_round(rest, sizes, bound)))
        label = written(_relabelled(label, "label", moved))
        if not more:
            break
        sizes = written(_relabelled(sizes, "label", moved).groupBy("label").agg(F.sum("size").alias("size")))
        left = _relabelled(_relabelled(rest, "a", moved), "b", moved).filter("a <> b")
        left = written(left.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("k").alias("k")))
        groups = components(left, "a", "b").select(F.col("node").alias("a"), F.col("component").alias("group"))
        todo = left.join(exchanged(groups), "a").select("a", "b", "k", "group")
    first = label.groupBy("label").agg(F.min("node").alias("component"))
    parts = label.join(exchanged(first), "label").select("node", "component", F.lit(True).alias("split"))
    lone = alone.join(exchanged(whole), "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(False).alias("split"))
    return whole.filter("not split").unionByName(parts).unionByName(lone)
