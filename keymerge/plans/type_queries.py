"""Registered type-inference and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantic import SEMANTIC_LADDER
from ..operators.types import cast_declared, infer_types, profile, split_by_type, type_ranges
from .registry import register, table

# A mixed column built from customer keys: e-mail, phone, float, integer and
# name shapes by market segment.  Valid in Spark SQL and DuckDB alike.
CONTACT = """CASE c_mktsegment
  WHEN 'AUTOMOBILE' THEN lower(replace(c_name, '#', '.')) || '@example.com'
  WHEN 'BUILDING' THEN '+1 555 ' || lpad(CAST(c_custkey AS STRING), 4, '0')
  WHEN 'FURNITURE' THEN CAST(c_acctbal AS STRING)
  WHEN 'MACHINERY' THEN CAST(c_custkey AS STRING)
  ELSE 'Household' END"""


def duck_semantic(v: str) -> str:
    """The semantic ladder as a DuckDB CASE (oracle side)."""
    arms = "\n".join(f"  WHEN regexp_matches({v}, '{pat.replace(chr(39), chr(39) * 2)}') THEN '{name}'"
                     for name, pat in SEMANTIC_LADDER)
    return f"CASE WHEN {v} IS NULL OR {v} = '' THEN NULL\n{arms}\n  ELSE 'text' END"


def _customers_contact(spark, sf):
    return table(spark, sf, "customer").withColumn("contact", F.expr(CONTACT))


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "is_final"]
_ORDER_TYPES = ["bigint", "bigint", "string", "double", "string", "string", "boolean"]


@register("infer_types", "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, COUNT(*) AS n_values FROM orders"
    for i, (c, t) in enumerate(zip(_ORDER_COLS, _ORDER_TYPES))))
def infer_types_q(spark, sf):
    """An all-string copy of orders is typed back (dates stay strings, flags become boolean)."""
    o = table(spark, sf, "orders")
    s = o.select(*[F.col(c).cast("string").alias(c) for c in o.columns],
                 F.when(F.col("o_orderstatus") == "F", "true").otherwise("False").alias("is_final"))
    return infer_types(s)


@register("profile_mixed", f"""
WITH c AS (SELECT c_name, c_mktsegment, {CONTACT} AS contact FROM customer),
lng AS (SELECT 'contact' AS col, contact AS v FROM c
        UNION ALL SELECT 'c_name', c_name FROM c
        UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM c),
typed AS (SELECT col, {duck_semantic('v')} AS semantic_type FROM lng),
counts AS (SELECT col, semantic_type, COUNT(*) AS n FROM typed WHERE semantic_type IS NOT NULL GROUP BY col, semantic_type)
SELECT col AS "column", semantic_type, n, n / SUM(n) OVER (PARTITION BY col) AS share,
       COUNT(*) OVER (PARTITION BY col) AS n_types, COUNT(*) OVER (PARTITION BY col) >= 2 AS is_mixed
FROM counts
""")
def profile_mixed(spark, sf):
    """Semantic type shares per column; ``contact`` is mixed."""
    return profile(_customers_contact(spark, sf), ["contact", "c_name", "c_mktsegment"])


_SPLIT_TYPES = ["email", "integer", "float", "phone", "name"]


@register("split_mixed", f"""
WITH c AS (SELECT c_custkey, {CONTACT} AS contact FROM customer),
t AS (SELECT c_custkey, contact, {duck_semantic('contact')} AS ty FROM c)
SELECT c_custkey, contact, {", ".join(f"CASE WHEN ty = '{t}' THEN contact END AS contact__{t}" for t in _SPLIT_TYPES)}
FROM t
""")
def split_mixed(spark, sf):
    """One virtual column per semantic type of the mixed column."""
    c = _customers_contact(spark, sf).select("c_custkey", "contact")
    return split_by_type(c, "contact", _SPLIT_TYPES)


@register("type_ranges", f"""
WITH t AS (SELECT c_custkey AS o, {duck_semantic(CONTACT)} AS ty FROM customer),
n AS (SELECT o, ty, row_number() OVER (ORDER BY o) AS rn, row_number() OVER (PARTITION BY ty ORDER BY o) AS rk FROM t)
SELECT 'contact' AS "column", MIN(rn) AS start_row, MAX(rn) AS end_row, COUNT(*) AS n_rows, ty AS semantic_type,
       CAST(1.0 AS DOUBLE) AS confidence
FROM n GROUP BY ty, rn - rk
""")
def type_ranges_q(spark, sf):
    """Runs of consecutive rows (by customer key) holding one semantic type."""
    return type_ranges(_customers_contact(spark, sf), "contact", "c_custkey")


@register("try_cast_mismatch", f"""
SELECT c_custkey, contact, TRY_CAST(contact AS DOUBLE) AS contact__cast,
       contact IS NOT NULL AND TRY_CAST(contact AS DOUBLE) IS NULL AS contact__mismatch
FROM (SELECT c_custkey, {CONTACT} AS contact FROM customer)
""")
def try_cast_mismatch(spark, sf):
    """A text column declared as a number; failed casts are flagged, never raised."""
    c = _customers_contact(spark, sf).select("c_custkey", "contact")
    return cast_declared(c, {"contact": "number"})


_K = len(SEMANTIC_LADDER) + 1
_TYPE_NO = "CASE ty " + " ".join(f"WHEN '{t}' THEN {k + 1}" for k, (t, _) in enumerate(SEMANTIC_LADDER)) + f" WHEN 'text' THEN {_K} END"
_TYPE_NAME = "CASE label " + " ".join(f"WHEN {k + 1} THEN '{t}'" for k, (t, _) in enumerate(SEMANTIC_LADDER)) + f" WHEN {_K} THEN 'text' END"


@register("type_ranges_noisy", f"""
WITH RECURSIVE t AS (SELECT c_custkey AS o, {duck_semantic(CONTACT)} AS ty FROM customer),
n AS (SELECT o, ty, row_number() OVER (ORDER BY o) AS rn, row_number() OVER (PARTITION BY ty ORDER BY o) AS rk FROM t),
g AS (SELECT MIN(rn) AS start_row, COUNT(*) AS n, {_TYPE_NO} AS ty FROM n GROUP BY ty, rn - rk),
u AS (SELECT *, row_number() OVER (ORDER BY start_row) AS r FROM g),
f(r, cost, back) AS (
  SELECT 0::BIGINT, [0::HUGEINT for x in range({_K})], range(1, {_K + 1})
  UNION ALL
  SELECT u.r, [least(cost[j], list_min(cost) + 2) + CASE WHEN u.ty IS NULL OR u.ty = j THEN 0 ELSE u.n END for j in range(1, {_K + 1})],
         [CASE WHEN cost[j] <= list_min(cost) + 2 THEN j ELSE list_position(cost, list_min(cost)) END for j in range(1, {_K + 1})]
  FROM f JOIN u ON u.r = f.r + 1),
b(r, label) AS (
  SELECT r, list_position(cost, list_min(cost))::BIGINT FROM f WHERE r = (SELECT MAX(r) FROM u)
  UNION ALL
  SELECT b.r - 1, f.back[b.label] FROM b JOIN f ON f.r = b.r WHERE b.r > 1),
l AS (SELECT u.*, label, row_number() OVER (ORDER BY u.r) - row_number() OVER (PARTITION BY label ORDER BY u.r) AS island FROM u JOIN b USING (r))
SELECT 'contact' AS "column", MIN(start_row) AS start_row, MIN(start_row) + CAST(SUM(n) AS BIGINT) - 1 AS end_row, CAST(SUM(n) AS BIGINT) AS n_rows, {_TYPE_NAME} AS semantic_type,
       CAST(SUM(CASE WHEN ty = label THEN n ELSE 0 END) AS DOUBLE) / CAST(SUM(CASE WHEN ty IS NOT NULL THEN n END) AS DOUBLE) AS confidence
FROM l GROUP BY label, island
""")
def type_ranges_noisy(spark, sf):
    """Ranges that tolerate stray values; a change of type costs as much as two strays."""
    return type_ranges(_customers_contact(spark, sf), "contact", "c_custkey", penalty=2)
