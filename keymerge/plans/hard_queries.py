"""Registered queries on inputs that are hard to get right: long ids, null keys, several rows
per key without a given order, text with quotes and line breaks, rows linked through two columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.entities import Link, entity_merge
from ..operators.incremental import remerge
from ..operators.merge import merge
from ..operators.quality import lineage
from ..operators.types import apply_types, split_by_type
from ..session import shared_scratch
from ..sources import read_csv, write
from ..spec import MergeSpec
from .registry import DEC, M, _orders_dec, _to_double, register, table
from .sqlmode import sql
from .type_queries import CONTACT, _SPLIT_TYPES, _customers_contact, duck_semantic


@register("infer_long_ids", """
SELECT CAST('12345678901' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS BIGINT) AS id19,
       '912345678901' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS id20,
       CASE WHEN o_orderstatus = 'F' THEN '9007199254740993' ELSE CAST(o_orderkey AS STRING) || '.5' END AS mixed
FROM orders
""")
def infer_long_ids(spark, sf):
    """Ids of 19 digits stay exact whole numbers, longer ones text; so do numbers that a double would change."""
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("12345678901"), key).alias("id19"), F.concat(F.lit("912345678901"), key).alias("id20"),
        F.when(F.col("o_orderstatus") == "F", "9007199254740993").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5"))).alias("mixed"))
    return apply_types(o)


@register("infer_sampled", """
SELECT o_orderkey, CASE WHEN o_orderkey < 700 THEN o_orderkey END AS code, o_orderkey >= 700 AS code__mismatch
FROM orders
""")
def infer_sampled(spark, sf):
    """A type found on the first rows; later values that do not fit it are flagged."""
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") < 700, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
    return apply_types(o.select("o_orderkey", text.alias("code")), sample=100, on_mismatch="flag")


@register("schema_hint", """
SELECT o_custkey, o_custkey__mismatch, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS done, o_orderstatus = 'P' AS done__mismatch
FROM (SELECT o_custkey, false AS o_custkey__mismatch, o_orderstatus FROM orders)
""")
def schema_hint(spark, sf):
    """T4: declared type names; text that is no boolean is flagged, not taken for false."""
    o = table(spark, sf, "orders")
    done = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "false").otherwise("perhaps")
    return apply_types(o.select(F.col("o_custkey").cast("string").alias("o_custkey"), done.alias("done")),
                       schema_hint={"o_custkey": "Int64", "done": "Boolean"}, on_mismatch="flag")


@register("split_discovered", f"""
WITH c AS (SELECT c_custkey, {CONTACT} AS contact FROM customer),
t AS (SELECT c_custkey, contact, {duck_semantic('contact')} AS ty FROM c)
SELECT c_custkey, contact, {", ".join(f"CASE WHEN ty = '{t}' THEN contact END AS contact__{t}" for t in _SPLIT_TYPES)}
FROM t
""")
def split_discovered(spark, sf):
    """The types of the mixed column are found in the data."""
    return split_by_type(_customers_contact(spark, sf).select("c_custkey", "contact"), "contact")


_REPRICED = "CASE WHEN o_orderpriority = '2-HIGH' THEN 'new ' || o_orderstatus ELSE o_orderstatus END"


@register("remerge_first_last", f"""
SELECT c.c_custkey AS c_custkey, arg_min(o.s, o.o_orderkey) AS first_status, arg_max(o.s, o.o_orderkey) AS last_status
FROM customer c JOIN (SELECT *, {_REPRICED} AS s FROM orders) o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def remerge_first_last(spark, sf):
    """Several rows per key and no given order; the scan order counts, as in a full merge."""
    spec = MergeSpec.build(["c_custkey"], [
        M("c_custkey", "firstMatch", ("customer", "c_custkey"), ("orders", "o_custkey")),
        M("first_status", "firstMatch", ("orders", "o_orderstatus")),
        M("last_status", "lastMatch", ("orders", "o_orderstatus")),
    ])
    cust, old = table(spark, sf, "customer"), table(spark, sf, "orders")
    new = old.withColumn("o_orderstatus", F.expr(_REPRICED))
    prev = merge({"customer": cust, "orders": old}, spec)
    return remerge(prev, {"customer": cust, "orders": old}, {"customer": cust, "orders": new}, spec, changed=["orders"])


@register("remerge_null_group", """
SELECT k, CAST(SUM(CAST(CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_totalprice AS DECIMAL(18,2)) * 2
       ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS k FROM orders) GROUP BY k
""")
def remerge_null_group(spark, sf):
    """With one source the null keys are a group, and it is refreshed like any other."""
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("orders", "k")), M("total", "sum", ("orders", "o_totalprice"))])
    old = _orders_dec(spark, sf).withColumn("k", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    new = old.withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") * 2)
                         .otherwise(F.col("o_totalprice")).cast(DEC))
    prev = merge({"orders": old}, spec)
    return _to_double(remerge(prev, {"orders": old}, {"orders": new}, spec, changed=["orders"]), "total")


@register("merge_or_multi_column", """
SELECT MIN(c_custkey) AS entity_id, MIN(c_custkey) AS e, COUNT(*) AS n, arg_min(c_name, c_custkey) AS c_name
FROM customer GROUP BY CAST(floor(c_custkey / 3) AS BIGINT)
""")
def merge_or_multi_column(spark, sf):
    """One key fed by two columns of a source, of different types; rows that share a value across them are one entity."""
    c = table(spark, sf, "customer").withColumn("guarantor", (F.floor(F.col("c_custkey") / 3) * 3).cast("double"))
    spec = MergeSpec.build(["e"], [
        M("e", "firstMatch", ("customer", "c_custkey"), ("customer", "guarantor")),
        M("n", "count", ("customer", "c_name")),
        M("c_name", "firstMatch", ("customer", "c_name")),
    ], logic="or")
    out = merge({"customer": c}, spec, ids={"customer": "c_custkey"}, order_by={"customer": "c_custkey"})
    return out.withColumn("e", F.col("e").cast("bigint"))


@register("merge_mixed_keys", """
SELECT CAST(c.c_custkey AS STRING) AS k, arg_min(c.c_name, c.c_custkey) AS c_name, COUNT(o.o_orderkey) AS n_orders
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus <> 'P' GROUP BY c.c_custkey
""")
def merge_mixed_keys(spark, sf):
    """A numeric key in one source, text (some of it no number) in the other."""
    o = table(spark, sf, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("C-"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string")))
    spec = MergeSpec.build(["k"], [
        M("k", "firstMatch", ("customer", "c_custkey"), ("orders", "o_custkey")),
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("n_orders", "count", ("orders", "o_orderkey")),
    ])
    return merge({"customer": table(spark, sf, "customer"), "orders": o}, spec)


@register("lineage_null_key", """
WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS k FROM orders),
m AS (SELECT k, COUNT(*) AS n FROM o GROUP BY k)
SELECT o.k AS k, 'n' AS field, 'orders' AS source, 'o_orderkey' AS "column", CAST(o.o_orderkey AS STRING) AS row_order,
       CAST(o.o_orderkey AS STRING) AS value, CAST(m.n AS STRING) AS merged
FROM o JOIN m ON o.k IS NOT DISTINCT FROM m.k
""")
def lineage_null_key(spark, sf):
    """Q5: the null group of a single source has a lineage too."""
    o = table(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("orders", "k")), M("n", "count", ("orders", "o_orderkey"))])
    return lineage({"orders": o}, spec, order_by={"orders": "o_orderkey"})


@register("csv_quoting", """
SELECT doc_id, md5('"' || source || '", said: ' || text || chr(10) || ' , ""') AS said FROM documents
""")
def csv_quoting(spark, sf):
    """S9 + S1: quotes, separators, leading blanks and line breaks come back as they were."""
    d = table(spark, sf, "documents")
    said = F.concat(F.lit('"'), F.col("source"), F.lit('", said: '), F.col("text"), F.lit('\n , ""'))
    path = shared_scratch(spark, "quoting")
    write(d.select("doc_id", said.alias("said")), path, "csv")
    back = read_csv(spark, path, multi_line=True, schema_hint={"doc_id": "Int64", "said": "String"})
    return back.select("doc_id", F.md5("said").alias("said"))


@register("entity_row_policies", """
SELECT c.c_custkey AS entity_id, c.c_custkey + c.c_nationkey AS rs, arg_min(o.o_orderstatus, o.o_orderkey) AS fr,
       COALESCE(string_agg(CAST(o.o_orderkey AS STRING), ',' ORDER BY o.o_orderkey), '') AS vs
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_nationkey
""")
def entity_row_policies(spark, sf):
    """Row policies see the rows of their own source only."""
    cust, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    out = entity_merge({"customer": cust, "orders": orders}, [Link("customer", "c_custkey", "orders", "o_custkey")], [
        M("entity", "firstMatch", ("customer", "c_custkey")),
        M("rs", "row_sum", ("customer", "c_custkey"), ("customer", "c_nationkey")),
        M("fr", "first_row", ("orders", "o_orderstatus")),
        M("vs", "values", ("orders", "o_orderkey")),
    ], ids={"customer": "c_custkey", "orders": "o_orderkey"}, order_by={"customer": "c_custkey", "orders": "o_orderkey"}, with_size=False)
    return out.select(F.col("entity").alias("entity_id"), "rs", "fr", F.array_join(F.col("vs").cast("array<string>"), ",").alias("vs"))


_SEMI = """
SELECT 'with' AS kind, c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_mktsegment
UNION ALL
SELECT 'without', c_mktsegment, count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_mktsegment
UNION ALL
SELECT 'either', coalesce(c_mktsegment, 'none'), count(*) FROM customer FULL OUTER JOIN orders ON c_custkey = o_orderkey GROUP BY c_mktsegment
"""


@register("sql_semi_anti_full", _SEMI)
def sql_semi_anti_full(spark, sf):
    """Semi, anti and full joins in SQL mode."""
    return sql({t: table(spark, sf, t) for t in ("customer", "orders")}, _SEMI)


_CUBE = """
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2, count(*) AS n FROM orders
GROUP BY CUBE (o_orderstatus, o_orderpriority)
UNION ALL
SELECT o_orderstatus, o_orderpriority, 2, 2, max(o_orderkey) FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))
"""


@register("sql_cube", _CUBE)
def sql_cube(spark, sf):
    """CUBE and GROUPING SETS in SQL mode."""
    return sql({"orders": table(spark, sf, "orders")}, _CUBE).withColumns({"g1": F.col("g1").cast("bigint"), "g2": F.col("g2").cast("bigint")})


@register("list_chunks", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rn FROM orders)
SELECT o_custkey, rn // 5 AS chunk, COUNT(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS orders
FROM r GROUP BY o_custkey, rn // 5
""")
def list_chunks(spark, sf):
    """P10 for keys of any size: each customer's orders by date, in chunks of at most five."""
    from ..operators.lists import chunked_values

    out = chunked_values(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"], chunk=5)
    return out.select("o_custkey", "chunk", "n", F.array_join(F.col("values").cast("array<string>"), ",").alias("orders"))


@register("list_chunks_hot", """
WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS rn FROM lineitem)
SELECT l_returnflag, rn // 1000 AS chunk, COUNT(*) AS n, md5(string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY rn)) AS digest
FROM r GROUP BY l_returnflag, rn // 1000
""")
def list_chunks_hot(spark, sf):
    """Three keys hold all rows; their lists in chunks of at most a thousand values."""
    from ..operators.lists import chunked_values

    out = chunked_values(table(spark, sf, "lineitem"), ["l_returnflag"], "l_orderkey", ["l_orderkey", "l_linenumber"], chunk=1000)
    return out.select("l_returnflag", "chunk", "n", F.md5(F.array_join(F.col("values").cast("array<string>"), ",")).alias("digest"))


@register("page_by_index", """
WITH m AS (SELECT o_custkey, COUNT(*) AS n_orders, MAX(o_orderkey) AS last_order FROM orders GROUP BY o_custkey)
SELECT row_number() OVER (ORDER BY n_orders DESC, o_custkey) - 1 AS _row, o_custkey, n_orders, last_order
FROM m QUALIFY _row >= 350 AND _row < 400
""")
def page_by_index(spark, sf):
    """The eighth page of fifty rows, read by the stored index."""
    from ..sources.pages import read_page, write_pages

    merged = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("last_order"))
    path = shared_scratch(spark, "pages")
    write_pages(merged, path, [F.desc("n_orders"), "o_custkey"])
    return read_page(spark, path, 7, 50)


@register("custom_states", """
WITH c AS (SELECT o.o_custkey AS k, o.o_orderpriority AS p, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
           JOIN (SELECT user_id FROM events) e ON e.user_id = o.o_custkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, p) AS place FROM c)
SELECT k AS o_custkey, string_agg(p || '=' || n, ',' ORDER BY place) AS top FROM r WHERE place <= 2 GROUP BY k
""")
def custom_states(spark, sf):
    """Each customer's two commonest order priorities, counted once per joined row of customer, orders and events, without that join."""
    from collections import Counter

    from ..operators.aggregates import Aggregate, fanned_aggregate

    def add(state, value):
        state[value] += 1
        return state

    def merge_counts(a, b):
        a.update(b)
        return a

    def commonest(state):
        return ",".join(f"{v}={n}" for v, n in sorted(state.items(), key=lambda x: (-x[1], x[0]))[:2])

    sources = {t: table(spark, sf, t) for t in ("orders", "customer", "events")}
    return fanned_aggregate(sources, {"orders": ["o_custkey"], "customer": ["c_custkey"], "events": ["user_id"]}, "orders", ["o_orderpriority"],
                            Aggregate(Counter, add, merge_counts, commonest, "string"), "top")


@register("remerge_states", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority,
                  CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) + 10 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS price
           FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT c.c_custkey, arg_min(c.c_name, c.c_custkey) AS c_name, CAST(COALESCE(SUM(price), 0) AS DOUBLE) AS total, COUNT(price) AS n,
       CAST(SUM(price) AS DOUBLE) / COUNT(price) AS mean, CAST(MIN(price) AS DOUBLE) AS low, MAX(o_orderdate) AS last_date,
       arg_min(o_orderpriority, o_orderkey) AS first_priority, arg_max(o_orderpriority, o_orderkey) AS last_priority
FROM customer c LEFT JOIN o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey
""")
def remerge_states(spark, sf):
    """One priority's orders go, the prices of a status change, by signed changes to stored states; equal to a full merge."""
    from ..operators.states import SIGN, apply_changes, merge_states

    spec = MergeSpec.build(["c_custkey"], [
        M("c_custkey", "firstMatch", ("customer", "c_custkey"), ("orders", "o_custkey")),
        M("c_name", "firstMatch", ("customer", "c_name")),
        M("total", "sum", ("orders", "o_totalprice")),
        M("n", "count", ("orders", "o_totalprice")),
        M("mean", "average", ("orders", "o_totalprice")),
        M("low", "min", ("orders", "o_totalprice")),
        M("last_date", "max", ("orders", "o_orderdate")),
        M("first_priority", "firstMatch", ("orders", "o_orderpriority")),
        M("last_priority", "lastMatch", ("orders", "o_orderpriority")),
    ])
    orders = table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    sources, order = {"customer": table(spark, sf, "customer"), "orders": orders}, {"customer": "c_custkey", "orders": "o_orderkey"}
    before, states = merge(sources, spec, how="left", order_by=order), merge_states(sources, spec, order)
    gone = orders.filter("o_orderpriority = '5-LOW' OR o_orderstatus = 'P'").withColumn(SIGN, F.lit(-1))
    came = (orders.filter("o_orderpriority <> '5-LOW' AND o_orderstatus = 'P'")
            .withColumn("o_totalprice", (F.col("o_totalprice") + 10).cast("decimal(18,2)")).withColumn(SIGN, F.lit(1)))
    out, _ = apply_changes(before, states, sources, spec, {"orders": gone.unionByName(came)}, how="left", order_by=order)
    return out.withColumns({c: F.col(c).cast("double") for c in ("total", "low")})
