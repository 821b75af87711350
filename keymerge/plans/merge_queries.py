"""Registered merge queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import merge
from ..session import materialize
from ..spec import MergeSpec, Policy
from .registry import DEC, M, _orders_dec, _to_double, register, table

# --------------------------------------------------------------------------- merge
CUSTOMER_ORDERS_KEY = M("c_custkey", "firstMatch", ("customer", "c_custkey"), ("orders", "o_custkey"))


@register("merge_inner", """
SELECT c.c_custkey AS c_custkey,
       arg_min(c.c_name, c.c_custkey) AS c_name,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
       COUNT(o.o_orderkey) AS n_orders,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o.o_totalprice) AS avg_order,
       MIN(o.o_orderdate) AS first_order,
       MAX(o.o_orderdate) AS last_order
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def merge_inner(spark, sf):
    """Flagship: customer x orders on the customer key, six policies."""
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("c_name", "firstMatch", ("customer", "c_name"), priority=("customer",)),
        M("total_spent", "sum", ("orders", "o_totalprice")),
        M("n_orders", "count", ("orders", "o_orderkey")),
        M("avg_order", "average", ("orders", "o_totalprice")),
        M("first_order", "min", ("orders", "o_orderdate")),
        M("last_order", "max", ("orders", "o_orderdate")),
    ])
    out = merge({"customer": table(spark, sf, "customer"), "orders": _orders_dec(spark, sf)}, spec, how="inner")
    return _to_double(out, "total_spent")


def _urgent_orders(spark, sf):
    """All orders; those that are not urgent carry a key that no customer has."""
    return _orders_dec(spark, sf).withColumn(
        "o_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).otherwise(-1 - F.col("o_orderkey")))


@register("merge_left", """
SELECT c.c_custkey AS c_custkey,
       arg_min(c.c_name, c.c_custkey) AS c_name,
       CAST(COALESCE(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS urgent_total,
       COUNT(o.o_orderkey) AS n_urgent,
       COUNT(*) AS n_rows
FROM customer c
LEFT JOIN (SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE -1 - o_orderkey END AS o_custkey) FROM orders) o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def merge_left(spark, sf):
    """Every customer kept; customers without an urgent order sum to 0."""
    urgent = _urgent_orders(spark, sf)
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("urgent_total", "sum", ("orders", "o_totalprice")),
        M("n_urgent", "count", ("orders", "o_orderkey")),
        M("n_rows", "count_rows", ("orders", "o_orderkey")),
    ])
    out = merge({"customer": table(spark, sf, "customer"), "orders": urgent}, spec, how="left")
    return _to_double(out, "urgent_total")


@register("merge_full", """
SELECT COALESCE(c.c_custkey, o.o_custkey) AS c_custkey,
       MIN(c.c_name) AS c_name,
       CAST(COALESCE(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS urgent_total,
       COUNT(o.o_orderkey) AS n_urgent,
       COUNT(*) AS n_rows
FROM (SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN -1000000000000 - c_custkey ELSE c_custkey END AS c_custkey) FROM customer) c
FULL OUTER JOIN (SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE -1 - o_orderkey END AS o_custkey) FROM orders) o ON c.c_custkey = o.o_custkey
GROUP BY COALESCE(c.c_custkey, o.o_custkey)
""")
def merge_full(spark, sf):
    """Keys of either side; customers of one segment have keys of their own, so order-only keys exist."""
    cust = table(spark, sf, "customer").withColumn(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", -1000000000000 - F.col("c_custkey")).otherwise(F.col("c_custkey")))
    urgent = _urgent_orders(spark, sf)
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("urgent_total", "sum", ("orders", "o_totalprice")),
        M("n_urgent", "count", ("orders", "o_orderkey")),
        M("n_rows", "count_rows", ("orders", "o_orderkey")),
    ])
    out = merge({"customer": cust, "orders": urgent}, spec, how="full")
    return _to_double(out, "urgent_total")


def _three_spec():
    return MergeSpec.build(["c_custkey"], [
        M("c_custkey", "firstMatch", ("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id")),
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("order_total", "sum", ("orders", "o_totalprice")),
        M("event_value", "sum", ("events", "value")),
        M("n_events", "count", ("events", "event_id")),
        M("n_rows", "count_rows", ("orders", "o_orderkey")),
        M("mean_value", "average", ("orders", "o_totalprice"), ("events", "value")),
        M("last_event", "max", ("events", "ts")),
    ])


def _three_sources(spark, sf):
    ev = table(spark, sf, "events").withColumn("value", F.col("value").cast(DEC))
    return {"customer": table(spark, sf, "customer"), "orders": _orders_dec(spark, sf), "events": ev}


@register("merge_three_rows", """
SELECT c.c_custkey AS c_custkey,
       MIN(c.c_name) AS c_name,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_total,
       CAST(SUM(CAST(e.value AS DECIMAL(18,2))) AS DOUBLE) AS event_value,
       COUNT(e.event_id) AS n_events,
       COUNT(*) AS n_rows,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) + SUM(CAST(e.value AS DECIMAL(18,2))) AS DOUBLE)
         / (COUNT(o.o_totalprice) + COUNT(e.value)) AS mean_value,
       MAX(e.ts) AS last_event
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN events e ON c.c_custkey = e.user_id
GROUP BY c.c_custkey
""")
def merge_three_rows(spark, sf):
    """J3 many-to-many, fan-out faithful: computed from per-source aggregates with row multipliers."""
    out = merge(_three_sources(spark, sf), _three_spec(), how="inner", fanout="rows")
    return _to_double(out, "order_total", "event_value")


@register("merge_three_safe", """
WITH c AS (SELECT c_custkey, MIN(c_name) AS c_name FROM customer GROUP BY c_custkey),
o AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS s, COUNT(o_totalprice) AS n, COUNT(*) AS r
      FROM orders GROUP BY o_custkey),
e AS (SELECT user_id, SUM(CAST(value AS DECIMAL(18,2))) AS s, COUNT(value) AS n, COUNT(event_id) AS ne,
             MAX(ts) AS mx FROM events GROUP BY user_id)
SELECT c.c_custkey AS c_custkey, c.c_name AS c_name,
       CAST(o.s AS DOUBLE) AS order_total, CAST(e.s AS DOUBLE) AS event_value, e.ne AS n_events,
       o.r AS n_rows, CAST(o.s + e.s AS DOUBLE) / (o.n + e.n) AS mean_value, e.mx AS last_event
FROM c JOIN o ON c.c_custkey = o.o_custkey JOIN e ON c.c_custkey = e.user_id
""")
def merge_three_safe(spark, sf):
    """J3 with ``fanout='safe'``: each source row counted once."""
    out = merge(_three_sources(spark, sf), _three_spec(), how="inner", fanout="safe")
    return _to_double(out, "order_total", "event_value")


@register("merge_composite", """
SELECT a.l_orderkey AS l_orderkey, a.l_partkey AS l_partkey,
       SUM(a.l_quantity) AS total_qty,
       COALESCE(SUM(r.l_quantity), 0) AS returned_qty,
       COUNT(*) AS n_rows,
       MAX(a.l_shipdate) AS last_ship
FROM lineitem a
LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') r
  ON a.l_orderkey = r.l_orderkey AND a.l_partkey = r.l_partkey
GROUP BY a.l_orderkey, a.l_partkey
""")
def merge_composite(spark, sf):
    """Two-column key (order, part): all lines left-merged with the returned lines."""
    li = table(spark, sf, "lineitem")
    spec = MergeSpec.build(["l_orderkey", "l_partkey"], [
        M("l_orderkey", "firstMatch", ("all", "l_orderkey"), ("ret", "l_orderkey")),
        M("l_partkey", "firstMatch", ("all", "l_partkey"), ("ret", "l_partkey")),
        M("total_qty", "sum", ("all", "l_quantity")),
        M("returned_qty", "sum", ("ret", "l_quantity")),
        M("n_rows", "count_rows", ("all", "l_quantity")),
        M("last_ship", "max", ("all", "l_shipdate")),
    ])
    return merge({"all": li, "ret": li.filter(F.col("l_returnflag") == "R")}, spec, how="left")


@register("merge_rows", """
SELECT c.c_custkey AS c_custkey, c.c_name AS c_name, o.o_orderkey AS o_orderkey,
       CAST(o.o_totalprice AS DOUBLE) AS o_totalprice
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
""")
def merge_rows(spark, sf):
    """Row merge without grouping (``dedupe=False``)."""
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("o_orderkey", "firstMatch", ("orders", "o_orderkey")),
        M("o_totalprice", "firstMatch", ("orders", "o_totalprice")),
    ])
    return merge({"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}, spec, dedupe=False)


_NULLABLE_NATION = "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END"


@register("null_keys", f"""
WITH c AS (SELECT {_NULLABLE_NATION} AS nk, c_custkey, c_acctbal FROM customer),
ca AS (SELECT nk, COUNT(c_custkey) AS n_customers, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS cust_bal
       FROM c WHERE nk IS NOT NULL GROUP BY nk),
sa AS (SELECT s_nationkey AS nk, COUNT(s_suppkey) AS n_suppliers FROM supplier GROUP BY s_nationkey)
SELECT ca.nk AS nationkey, ca.n_customers AS n_customers, sa.n_suppliers AS n_suppliers, ca.cust_bal AS cust_bal
FROM ca JOIN sa ON ca.nk = sa.nk
""")
def null_keys(spark, sf):
    """Null keys never match; with two sources rows with a null key are left out."""
    cust = table(spark, sf, "customer").withColumn("nk", F.expr(_NULLABLE_NATION))
    cust = cust.withColumn("c_acctbal", F.col("c_acctbal").cast(DEC))
    spec = MergeSpec.build(["nationkey"], [
        M("nationkey", "firstMatch", ("customer", "nk"), ("supplier", "s_nationkey")),
        M("n_customers", "count", ("customer", "c_custkey")),
        M("n_suppliers", "count", ("supplier", "s_suppkey")),
        M("cust_bal", "sum", ("customer", "c_acctbal")),
    ])
    out = merge({"customer": cust, "supplier": table(spark, sf, "supplier")}, spec, fanout="safe")
    return _to_double(out, "cust_bal")


@register("null_key_single", f"""
SELECT {_NULLABLE_NATION} AS nationkey, COUNT(c_custkey) AS n_customers,
       CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS cust_bal
FROM customer GROUP BY 1
""")
def null_key_single(spark, sf):
    """With a single source the null key forms its own group."""
    cust = table(spark, sf, "customer").withColumn("nk", F.expr(_NULLABLE_NATION))
    cust = cust.withColumn("c_acctbal", F.col("c_acctbal").cast(DEC))
    spec = MergeSpec.build(["nationkey"], [
        M("nationkey", "firstMatch", ("customer", "nk")),
        M("n_customers", "count", ("customer", "c_custkey")),
        M("cust_bal", "sum", ("customer", "c_acctbal")),
    ])
    return _to_double(merge({"customer": cust}, spec), "cust_bal")


_SEG = "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END"
_PRIO = "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END"


@register("first_last_policies", f"""
WITH c AS (SELECT c_custkey, {_SEG} AS seg FROM customer),
o AS (SELECT o_custkey, o_orderkey, {_PRIO} AS prio FROM orders)
SELECT c.c_custkey AS c_custkey,
       COALESCE(arg_min(c.seg, c.c_custkey), arg_min(o.prio, o.o_orderkey)) AS label,
       arg_min_null(o.prio, o.o_orderkey) AS first_prio,
       arg_max(o.prio, o.o_orderkey) AS last_prio
FROM c JOIN o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def first_last_policies(spark, sf):
    """P1 firstMatch with source priority, P2 first_row (nulls kept), P12 lastMatch; order = o_orderkey."""
    cust = table(spark, sf, "customer").withColumn("seg", F.expr(_SEG))
    orders = table(spark, sf, "orders").withColumn("prio", F.expr(_PRIO))
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("label", "firstMatch", ("orders", "prio"), ("customer", "seg"), priority=("customer",)),
        M("first_prio", "first_row", ("orders", "prio")),
        M("last_prio", "lastMatch", ("orders", "prio")),
    ])
    return merge({"customer": cust, "orders": orders}, spec,
                 order_by={"customer": "c_custkey", "orders": "o_orderkey"})


_NN = "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END"
_OK = "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey END"


@register("row_sum_count_rows", f"""
SELECT c.c_custkey AS c_custkey,
       CAST(COALESCE(SUM(c.a + o.b), 0) AS BIGINT) AS row_total,
       COUNT(*) AS n_rows,
       CAST(COALESCE(SUM(c.a), 0) + COALESCE(SUM(o.b), 0) AS BIGINT) AS total
FROM (SELECT c_custkey, {_NN} AS a FROM customer) c
JOIN (SELECT o_custkey, {_OK} AS b FROM orders) o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def row_sum_count_rows(spark, sf):
    """P4 row_sum (a null anywhere drops the row's sum) and P6 count_rows, vs P3 sum."""
    cust = table(spark, sf, "customer").withColumn("a", F.expr(_NN).cast("bigint"))
    orders = table(spark, sf, "orders").withColumn("b", F.expr(_OK))
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("row_total", "row_sum", ("customer", "a"), ("orders", "b")),
        M("n_rows", "count_rows", ("orders", "b")),
        M("total", "sum", ("customer", "a"), ("orders", "b")),
    ])
    return merge({"customer": cust, "orders": orders}, spec)


@register("list_policies", """
SELECT o_custkey AS o_custkey,
       array_to_string(list(CAST((o_orderkey + o_custkey) / 2.0 AS DOUBLE) ORDER BY o_orderkey), ';') AS row_means,
       array_to_string(list(o_orderpriority ORDER BY o_orderkey), ';') AS priorities,
       string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS statuses
FROM orders GROUP BY o_custkey
""")
def list_policies(spark, sf):
    """P9 row_means, P10 values, P11 concat; lists rendered as strings in row order."""
    spec = MergeSpec.build(["o_custkey"], [
        M("o_custkey", "firstMatch", ("orders", "o_custkey")),
        M("row_means", "row_means", ("orders", "o_orderkey"), ("orders", "o_custkey")),
        M("priorities", "values", ("orders", "o_orderpriority")),
        M("statuses", "concat", ("orders", "o_orderstatus"), sep="|"),
    ])
    out = merge({"orders": table(spark, sf, "orders")}, spec, order_by={"orders": "o_orderkey"})
    return out.select("o_custkey", F.array_join(F.col("row_means").cast("array<string>"), ";").alias("row_means"),
                      F.array_join("priorities", ";").alias("priorities"), "statuses")


@register("list_policies_rows", f"""
SELECT c.c_custkey AS c_custkey,
       array_to_string(list(COALESCE(o.prio, c.c_mktsegment) ORDER BY o.o_orderkey), ';') AS merged,
       string_agg(o.o_orderstatus, '|' ORDER BY o.o_orderkey) AS statuses
FROM customer c JOIN (SELECT o_custkey, o_orderkey, o_orderstatus, {_PRIO} AS prio FROM orders) o
  ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def list_policies_rows(spark, sf):
    """P10 coalesced_values over two sources: computed on the row-level join and joined back by key."""
    orders = table(spark, sf, "orders").withColumn("prio", F.expr(_PRIO))
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("merged", "coalesced_values", ("orders", "prio"), ("customer", "c_mktsegment")),
        M("statuses", "concat", ("orders", "o_orderstatus"), sep="|"),
    ])
    out = merge({"customer": table(spark, sf, "customer"), "orders": orders}, spec,
                order_by={"customer": "c_custkey", "orders": "o_orderkey"})
    return out.select("c_custkey", F.array_join("merged", ";").alias("merged"), "statuses")


@register("custom_policy", """
SELECT o_custkey AS o_custkey, COUNT(DISTINCT o_orderpriority) AS n_priorities,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_custkey
""")
def custom_policy(spark, sf):
    """A caller-supplied aggregate (count distinct) next to a built-in policy."""
    spec = MergeSpec.build(["o_custkey"], [
        M("o_custkey", "firstMatch", ("orders", "o_custkey")),
        M("n_priorities", Policy("custom", func=lambda c: F.count_distinct(c)), ("orders", "o_orderpriority")),
        M("total", "sum", ("orders", "o_totalprice")),
    ])
    return _to_double(merge({"orders": _orders_dec(spark, sf)}, spec), "total")


@register("passthrough", """
SELECT c.c_custkey AS c_custkey, arg_min_null(c.c_mktsegment, c.c_custkey) AS c_mktsegment,
       COUNT(o.o_orderkey) AS n_orders
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey
""")
def passthrough(spark, sf):
    """a destination field with no mapping takes the same-named source column."""
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("n_orders", "count", ("orders", "o_orderkey")),
    ], destination=["c_custkey", "c_mktsegment", "n_orders"])
    return merge({"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}, spec)


@register("fixture_identity", """
SELECT c_custkey AS customer_id FROM customer GROUP BY c_custkey
""")
def fixture_identity(spark, sf):
    """The identity fixture: a source merged with itself on its key, one output column."""
    cust = table(spark, sf, "customer")
    spec = MergeSpec.build(["customer_id"], [
        M("customer_id", "firstMatch", ("left", "c_custkey"), ("right", "c_custkey"))])
    return merge({"left": cust, "right": cust}, spec)


@register("fixture_join", """
SELECT c.c_custkey AS customer_id
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def fixture_join(spark, sf):
    """The customer-order fixture: two sources joined on the customer key, one output column."""
    spec = MergeSpec.build(["customer_id"], [
        M("customer_id", "firstMatch", ("customers", "c_custkey"), ("orders", "o_custkey"))])
    return merge({"customers": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}, spec)


@register("merge_keep_order", """
SELECT c.c_custkey AS c_custkey, arg_min(c.c_name, c.c_custkey) AS c_name,
       CAST(COALESCE(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS urgent_total,
       c.c_custkey AS place
FROM customer c
LEFT JOIN (SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE -1 - o_orderkey END AS o_custkey) FROM orders) o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def merge_keep_order(spark, sf):
    """A1: one row per key in first-seen order (a range-partitioned sort at the output only)."""
    urgent = _urgent_orders(spark, sf)
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("urgent_total", "sum", ("orders", "o_totalprice")),
    ])
    out = merge({"customer": table(spark, sf, "customer"), "orders": urgent}, spec, how="left", keep_order=True,
                order_by={"customer": "c_custkey", "orders": "o_orderkey"})
    return _placed(_to_double(out, "urgent_total"))


def _placed(df):
    """Rows with their place in the result's order, so that a comparison of rows sees the order."""
    part = df.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    part = materialize(part)
    before = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = F.col("_i") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    return part.join(F.broadcast(before), "_p").withColumn("place", F.col("_before") + inside).drop("_p", "_i", "_before")
