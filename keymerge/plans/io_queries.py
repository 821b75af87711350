"""Registered predicate, SQL-mode, source/sink and preview queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import Contains, Equals, Expr, GreaterThan, IsNotNull, IsNull, LessThan, Not, Regex
from ..functions.predicates import filter_rows, select_columns
from ..session import shared_scratch
from ..sources import payload_csv, preview, read_csv, read_tsv, write
from .merge_queries import merge_inner
from .registry import DEC, register, table
from .sqlmode import sql

# ------------------------------------------------------------------ predicates


@register("predicates_customer", """
SELECT c_custkey, c_name, c_acctbal FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND NOT (c_nationkey = 3)
""")
def predicates_customer(spark, sf):
    """F4 Equals (typed literal), F8 GreaterThan, F9 And/Not, F2 select."""
    c = table(spark, sf, "customer")
    p = Equals("c_mktsegment", "BUILDING") & GreaterThan("c_acctbal", "5000") & ~Equals("c_nationkey", "3")
    return select_columns(filter_rows(c, p), ["c_custkey", "c_name", "c_acctbal"])


@register("predicates_part", """
SELECT p_partkey, p_name, p_type, p_retailprice FROM part
WHERE (p_name LIKE '%blue%' OR regexp_matches(p_type, '^(SMALL|LARGE)$')) AND p_retailprice < 950
""")
def predicates_part(spark, sf):
    """F5 Contains, F6 Regex, F9 Or, F8 LessThan."""
    p = (Contains("p_name", "blue") | Regex("p_type", "^(SMALL|LARGE)$")) & LessThan("p_retailprice", "950")
    return select_columns(filter_rows(table(spark, sf, "part"), p), ["p_partkey", "p_name", "p_type", "p_retailprice"])


@register("predicates_documents", """
SELECT doc_id, lang, source, n_chars,
       (CASE WHEN lang = 'de' THEN NULL WHEN lang = 'es' THEN '' ELSE lang END) AS lang2
FROM documents
WHERE NOT ((CASE WHEN lang = 'de' THEN NULL WHEN lang = 'es' THEN '' ELSE lang END) IS NULL
           OR (CASE WHEN lang = 'de' THEN NULL WHEN lang = 'es' THEN '' ELSE lang END) = '')
  AND text IS NOT NULL AND n_chars > 1000 AND source IN ('src1', 'src2', 'src3')
""")
def predicates_documents(spark, sf):
    """F7 IsNull (null or empty) / IsNotNull, F3 SQL-expression filter."""
    d = table(spark, sf, "documents").withColumn(
        "lang2", F.expr("CASE WHEN lang = 'de' THEN NULL WHEN lang = 'es' THEN '' ELSE lang END"))
    p = Not(IsNull("lang2")) & IsNotNull("text") & Expr("n_chars > 1000 AND source IN ('src1', 'src2', 'src3')")
    return filter_rows(d, p).select("doc_id", "lang", "source", "n_chars", "lang2")


# -------------------------------------------------------------------- SQL mode
SQL_JOIN_AGG = """
SELECT n.n_name AS nation, c.c_mktsegment AS segment,
       COUNT(DISTINCT o.o_orderkey) AS n_orders,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE l.l_returnflag <> 'R'
GROUP BY n.n_name, c.c_mktsegment
HAVING COUNT(DISTINCT o.o_orderkey) > 5
"""

SQL_WINDOW = """
SELECT c_custkey, c_nationkey, CAST(total AS DOUBLE) AS total,
       CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS BIGINT) AS rnk,
       CAST(SUM(total) OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running,
       LAG(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS prev_customer
FROM (SELECT c.c_custkey, c.c_nationkey, SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS total
      FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
      GROUP BY c.c_custkey, c.c_nationkey) t
"""

SQL_SETOP = """
SELECT o_custkey AS custkey, 'urgent_not_low' AS kind FROM (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
  EXCEPT
  SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') a
UNION ALL
SELECT o_custkey, 'urgent_and_low' FROM (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
  INTERSECT
  SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') b
UNION ALL
SELECT user_id, 'active' FROM (SELECT user_id FROM events UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') c
"""

SQL_ROLLUP = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n_lines,
       SUM(l_quantity) AS sum_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price
FROM lineitem
GROUP BY ROLLUP (l_returnflag, l_linestatus)
"""

SQL_TOPK = """
SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate
FROM orders
ORDER BY o_totalprice DESC, o_orderkey
LIMIT 10
"""

def _sql_sources(spark, sf, names):
    return {n: table(spark, sf, n) for n in names}


@register("sql_join_agg", SQL_JOIN_AGG)
def sql_join_agg(spark, sf):
    """J-SQL: four-way join, aggregate, HAVING, DISTINCT count."""
    return sql(_sql_sources(spark, sf, ("customer", "orders", "lineitem", "nation")), SQL_JOIN_AGG)


@register("sql_window", SQL_WINDOW)
def sql_window(spark, sf):
    """J-SQL: ranking, running sum and LAG over partitions."""
    return sql(_sql_sources(spark, sf, ("customer", "orders")), SQL_WINDOW)


@register("sql_setop", SQL_SETOP)
def sql_setop(spark, sf):
    """J-SQL: EXCEPT, INTERSECT, UNION, UNION ALL."""
    return sql(_sql_sources(spark, sf, ("orders", "events")), SQL_SETOP)


@register("sql_rollup", SQL_ROLLUP)
def sql_rollup(spark, sf):
    """J-SQL: GROUP BY ROLLUP."""
    return sql(_sql_sources(spark, sf, ("lineitem",)), SQL_ROLLUP)


@register("sql_topk", SQL_TOPK)
def sql_topk(spark, sf):
    """J-SQL: ORDER BY + LIMIT (top-k; the limit is the feature)."""
    return sql(_sql_sources(spark, sf, ("orders",)), SQL_TOPK)



SQL_SCALARS = """
SELECT upper(substr(event_type, 1, 3)) AS type3,
       CAST(EXTRACT(YEAR FROM ts) AS BIGINT) AS yr,
       CAST(EXTRACT(MONTH FROM ts) AS BIGINT) AS mon,
       COUNT(*) AS n,
       SUM(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k_sum,
       MAX(length(concat(event_type, '#', CAST(user_id AS STRING)))) AS max_len,
       CAST(SUM(abs(CAST(value AS DECIMAL(18,2)) - 5)) AS DOUBLE) AS abs_dev,
       SUM(CASE WHEN coalesce(nullif(event_type, 'view'), 'none') = 'none' THEN 1 ELSE 0 END) AS n_view
FROM events
GROUP BY upper(substr(event_type, 1, 3)), EXTRACT(YEAR FROM ts), EXTRACT(MONTH FROM ts)
"""

SQL_SCALARS_DUCK = """
SELECT upper(substr(event_type, 1, 3)) AS type3,
       CAST(EXTRACT(YEAR FROM ts) AS BIGINT) AS yr,
       CAST(EXTRACT(MONTH FROM ts) AS BIGINT) AS mon,
       COUNT(*) AS n,
       CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
       MAX(length(concat(event_type, '#', CAST(user_id AS VARCHAR)))) AS max_len,
       CAST(SUM(abs(CAST(value AS DECIMAL(18,2)) - 5)) AS DOUBLE) AS abs_dev,
       CAST(SUM(CASE WHEN coalesce(nullif(event_type, 'view'), 'none') = 'none' THEN 1 ELSE 0 END) AS BIGINT) AS n_view
FROM events
GROUP BY upper(substr(event_type, 1, 3)), EXTRACT(YEAR FROM ts), EXTRACT(MONTH FROM ts)
"""


@register("sql_scalars", SQL_SCALARS_DUCK)
def sql_scalars(spark, sf):
    """J-SQL: string, date-part, JSON, math and conditional scalars inside an aggregate."""
    return sql(_sql_sources(spark, sf, ("events",)), SQL_SCALARS)


# --------------------------------------------------------------- sources/sinks
@register("csv_roundtrip", """
SELECT o_orderpriority, COUNT(*) AS n_orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       COUNT(DISTINCT o_custkey) AS n_customers, MAX(o_orderkey) AS max_orderkey
FROM orders GROUP BY o_orderpriority
""")
def csv_roundtrip(spark, sf):
    """S9 + S1: write orders as CSV (distributed), read back with type inference, aggregate."""
    path = shared_scratch(spark, "csv")
    write(table(spark, sf, "orders"), path, "csv")
    back = read_csv(spark, path)
    return back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast(DEC)).cast("double").alias("total"),
        F.count_distinct("o_custkey").alias("n_customers"), F.max("o_orderkey").alias("max_orderkey"))


@register("tsv_roundtrip", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n_lines, SUM(l_quantity) AS sum_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def tsv_roundtrip(spark, sf):
    """S10 + S2: write lineitem as TSV, read back typed, aggregate."""
    path = shared_scratch(spark, "tsv")
    write(table(spark, sf, "lineitem"), path, "tsv")
    back = read_tsv(spark, path)
    return back.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.sum(F.col("l_extendedprice").cast(DEC)).cast("double").alias("sum_price"))


@register("payload_csv", """
SELECT l_orderkey, COUNT(*) AS n_lines, SUM(l_quantity) AS qty, MAX(l_linenumber) AS max_line
FROM lineitem GROUP BY l_orderkey
""")
def payload_csv_q(spark, sf):
    """S3 re-aimed: a column of CSV payloads (one per order) parsed into rows on the executors."""
    li = table(spark, sf, "lineitem")
    line = F.concat_ws(",", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"))
    # One payload per (order, block of 32 line numbers): line numbers are unique within an
    # order, so no payload holds more than 32 lines however large an order is.
    docs = li.groupBy("l_orderkey", F.floor(F.col("l_linenumber") / 32).alias("_chunk")).agg(
        F.concat_ws("\n", F.lit("l_linenumber,l_quantity"), F.collect_list(line)).alias("payload"))
    rows = payload_csv(docs, "payload", "l_linenumber INT, l_quantity DOUBLE", keep=["l_orderkey"])
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"),
                                          F.max("l_linenumber").alias("max_line"))


@register("source_uri", """
SELECT o_orderpriority, COUNT(*) AS n_orders, MAX(o_orderdate) AS last_order
FROM orders GROUP BY o_orderpriority
""")
def source_uri(spark, sf):
    """A source given as ``id:URI`` with the format taken from the extension."""
    import os

    from ..sources import load_source

    uri = "file://" + os.path.abspath(f"{sf.rstrip('/')}/orders.parquet")
    orders = load_source(spark, f"orders:{uri}")
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"),
                                                  F.max("o_orderdate").alias("last_order"))


@register("preview_page", """
WITH m AS (
  SELECT c.c_custkey AS c_custkey, arg_min(c.c_name, c.c_custkey) AS c_name,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
         COUNT(o.o_orderkey) AS n_orders,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o.o_totalprice) AS avg_order,
         MIN(o.o_orderdate) AS first_order, MAX(o.o_orderdate) AS last_order
  FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey)
SELECT * FROM m ORDER BY total_spent DESC, c_custkey LIMIT 50 OFFSET 100
""")
def preview_page(spark, sf):
    """A page (rows 101-150) of the merged result in a total order."""
    return preview(merge_inner(spark, sf), 50, offset=100, order_by=[F.desc("total_spent"), "c_custkey"])


@register("payload_quoted", """
SELECT source, doc_id, md5(text) AS said, CAST(length(text) AS INTEGER) AS n FROM documents
""")
def payload_quoted(spark, sf):
    """S3 re-aimed: payloads whose fields hold quotes, separators and line breaks, a few records each."""
    d = table(spark, sf, "documents")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat_ws(",", F.col("doc_id").cast("string"), quoted, F.length("text").cast("string"))
    # A payload holds the documents of a source and a block of eight ids.
    payloads = d.groupBy("source", F.floor(F.col("doc_id") / 8).alias("_block")).agg(
        F.concat(F.lit('doc_id,"te""xt",n\n'), F.concat_ws("\r\n", F.collect_list(record))).alias("payload"))
    rows = payload_csv(payloads, "payload", "doc_id BIGINT, text STRING, n INT", keep=["source"])
    return rows.select("source", "doc_id", F.md5("text").alias("said"), "n")


@register("tsv_breaks", """
SELECT lang, COUNT(*) AS n_docs, SUM(doc_id) AS ids, SUM(length(text)) AS chars, SUM(length(text) - length(replace(text, chr(10), ''))) AS breaks
FROM documents GROUP BY lang
""")
def tsv_breaks(spark, sf):
    """Fields with line breaks in quotes, written and read back typed, in splits."""
    path = shared_scratch(spark, "breaks")
    write(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, "tsv")
    back = read_tsv(spark, path, multi_line=True)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"),
                                    F.sum(breaks).alias("breaks"))
