"""Registered quality, lineage, coverage and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import merge
from ..operators.incremental import remerge
from ..operators.quality import coverage, lineage, unresolved
from ..spec import MergeSpec
from .merge_queries import CUSTOMER_ORDERS_KEY, _urgent_orders
from .registry import DEC, M, _orders_dec, _to_double, register, table
from .type_queries import CONTACT


@register("unresolved", """
WITH c AS (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -1000000000000 - c_custkey END AS c_custkey,
                  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END AS nm FROM customer),
o AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE -1 - o_orderkey END AS o_custkey, o_orderkey FROM orders)
SELECT 'customer' AS source, c_custkey, CAST(NULL AS VARCHAR) AS field, 'no match in orders' AS reason,
       COUNT(*) AS n_rows
FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c.c_custkey) GROUP BY c_custkey
UNION ALL
SELECT 'orders', o_custkey, NULL, 'no match in customer', COUNT(*)
FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.c_custkey = o.o_custkey) GROUP BY o_custkey
UNION ALL
SELECT 'customer', c_custkey, 'customer.nm', 'empty field', COUNT(*) FROM c WHERE nm IS NULL OR nm = '' GROUP BY c_custkey
UNION ALL
SELECT 'orders', o_custkey, 'orders.o_orderkey', 'empty field', COUNT(*) FROM o WHERE o_orderkey IS NULL GROUP BY o_custkey
""")
def unresolved_q(spark, sf):
    """Q1/Q2: keys without a partner in either direction, and empty mapped fields."""
    own_key = F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-1000000000000 - F.col("c_custkey"))
    cust = (table(spark, sf, "customer").withColumn("c_custkey", own_key)
            .withColumn("nm", F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END")))
    urgent = _urgent_orders(spark, sf)
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("name", "firstMatch", ("customer", "nm")),
        M("n_orders", "count", ("orders", "o_orderkey")),
    ])
    return unresolved({"customer": cust, "orders": urgent}, spec)


def _lineage_spec():
    return MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("prio", "firstMatch", ("orders", "o_orderpriority")),
        M("n", "count", ("orders", "o_orderkey")),
    ])


@register("lineage", """
WITH m AS (SELECT c.c_custkey, arg_min(c.c_name, c.c_custkey) AS c_name,
                  arg_min(o.o_orderpriority, o.o_orderkey) AS prio, COUNT(o.o_orderkey) AS n
           FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey)
SELECT m.c_custkey AS c_custkey, 'c_name' AS field, 'customer' AS source, 'c_name' AS "column",
       CAST(c.c_custkey AS VARCHAR) AS row_order, c.c_name AS value, m.c_name AS merged
FROM m JOIN customer c ON c.c_custkey = m.c_custkey
UNION ALL
SELECT m.c_custkey, 'prio', 'orders', 'o_orderpriority', CAST(o.o_orderkey AS VARCHAR), o.o_orderpriority, m.prio
FROM m JOIN orders o ON o.o_custkey = m.c_custkey
UNION ALL
SELECT m.c_custkey, 'n', 'orders', 'o_orderkey', CAST(o.o_orderkey AS VARCHAR), CAST(o.o_orderkey AS VARCHAR),
       CAST(m.n AS VARCHAR)
FROM m JOIN orders o ON o.o_custkey = m.c_custkey
""")
def lineage_q(spark, sf):
    """Q5: every source value behind each merged value, next to the merged value."""
    src = {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}
    return lineage(src, _lineage_spec(), order_by={"customer": "c_custkey", "orders": "o_orderkey"})


_COVER = [("customer", "c_custkey", "c_custkey", 1), ("orders", "o_custkey", "c_custkey", 1),
          ("customer", "c_name", "c_name", 1), ("orders", "o_orderpriority", "prio", 1),
          ("orders", "o_orderkey", "n", 1)]


@register("coverage", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS source, '{c}' AS \"column\", '{u}' AS used_by, CAST({n} AS INTEGER) AS n_fields, TRUE AS present, "
    f"COUNT(*) AS n_rows, COUNT({c}) AS n_values FROM {s}" for s, c, u, n in _COVER))
def coverage_q(spark, sf):
    """Q6: destination fields per source column, with row and non-null counts."""
    src = {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}
    return coverage(src, _lineage_spec())


@register("remerge", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate,
                  CAST(CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_totalprice AS DECIMAL(18,2)) * 2
                            ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS p
           FROM orders)
SELECT c.c_custkey AS c_custkey, arg_min(c.c_name, c.c_custkey) AS c_name, CAST(SUM(o.p) AS DOUBLE) AS total_spent,
       COUNT(o.o_orderkey) AS n_orders, MAX(o.o_orderdate) AS last_order
FROM customer c JOIN o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey
""")
def remerge_q(spark, sf):
    """Orders of one priority are repriced; only the customers they touch are re-merged."""
    spec = MergeSpec.build(["c_custkey"], [
        CUSTOMER_ORDERS_KEY,
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("total_spent", "sum", ("orders", "o_totalprice")),
        M("n_orders", "count", ("orders", "o_orderkey")),
        M("last_order", "max", ("orders", "o_orderdate")),
    ])
    cust = table(spark, sf, "customer")
    old = _orders_dec(spark, sf)
    new = old.withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") * 2)
                         .otherwise(F.col("o_totalprice")).cast(DEC))
    prev = merge({"customer": cust, "orders": old}, spec)
    out = remerge(prev, {"customer": cust, "orders": old}, {"customer": cust, "orders": new}, spec, changed=["orders"])
    return _to_double(out, "total_spent")


@register("unresolved_types", f"""
SELECT 'customer' AS source, c_custkey, 'customer.contact' AS field, 'type mismatch' AS reason, COUNT(*) AS n_rows
FROM (SELECT c_custkey, {CONTACT} AS contact FROM customer)
WHERE contact IS NOT NULL AND contact <> '' AND TRY_CAST(contact AS DOUBLE) IS NULL
GROUP BY c_custkey
""")
def unresolved_types(spark, sf):
    """Q3: text that is not a number under a numeric policy is reported per key (the merge itself reads it as null)."""
    cust = table(spark, sf, "customer").withColumn("contact", F.expr(CONTACT))
    spec = MergeSpec.build(["c_custkey"], [
        M("c_custkey", "firstMatch", ("customer", "c_custkey")),
        M("contact_total", "sum", ("customer", "contact")),
    ])
    return unresolved({"customer": cust}, spec)
