"""Registered entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import merge
from ..operators.entities import EMAIL_RE, Link, entity_merge, link_pairs
from ..spec import MergeSpec
from .registry import DEC, M, _to_double, register, table

_K1 = "CAST(floor(c_acctbal / 2) AS BIGINT)"
_K2 = "CAST(floor(c_custkey / 2) AS BIGINT)"

_OR_ORACLE = f"""
WITH RECURSIVE c AS (SELECT c_custkey AS id, {_K1} AS k1, {_K2} AS k2, c_acctbal FROM customer),
e AS (SELECT a.id AS s, b.id AS d FROM c a JOIN c b ON a.k1 = b.k1
      UNION SELECT a.id, b.id FROM c a JOIN c b ON a.k2 = b.k2),
r(s, d) AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s),
comp AS (SELECT s AS id, MIN(d) AS root FROM r GROUP BY s),
sized AS (SELECT id, root, COUNT(*) OVER (PARTITION BY root) AS size FROM comp)
SELECT {{entity}} AS entity_id, arg_min(c.k1, c.id) AS k1, arg_min(c.k2, c.id) AS k2, COUNT(*) AS n_members,
       CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_bal
FROM c JOIN sized USING (id)
GROUP BY {{entity}}
"""


def _or_spec():
    return MergeSpec.build(["k1", "k2"], [
        M("k1", "firstMatch", ("customer", "k1")),
        M("k2", "firstMatch", ("customer", "k2")),
        M("n_members", "count_rows", ("customer", "c_custkey")),
        M("total_bal", "sum", ("customer", "c_acctbal")),
    ], logic="or")


def _or_customers(spark, sf):
    return (table(spark, sf, "customer").withColumn("k1", F.expr(_K1)).withColumn("k2", F.expr(_K2))
            .withColumn("c_acctbal", F.col("c_acctbal").cast(DEC)))


@register("merge_or_keys", _OR_ORACLE.format(entity="sized.root"))
def merge_or_keys(spark, sf):
    """Rows sharing either key are one entity (transitive closure), then merged."""
    out = merge({"customer": _or_customers(spark, sf)}, _or_spec(), ids={"customer": "c_custkey"},
                order_by={"customer": "c_custkey"})
    return _to_double(out, "total_bal")


@register("bounded_clusters", _OR_ORACLE.format(entity="CASE WHEN sized.size > 3 THEN sized.id ELSE sized.root END"))
def bounded_clusters(spark, sf):
    """Components above 3 rows stay unmerged (one entity per row)."""
    out = merge({"customer": _or_customers(spark, sf)}, _or_spec(), ids={"customer": "c_custkey"},
                order_by={"customer": "c_custkey"}, max_cluster_size=3)
    return _to_double(out, "total_bal")


@register("link_fuzzy", """
WITH v AS (SELECT DISTINCT p_brand AS block, p_name AS value FROM part WHERE p_name IS NOT NULL AND length(p_name) > 0)
SELECT a.block AS block, a.value AS a, b.value AS b,
       CAST(levenshtein(a.value, b.value) AS INTEGER) AS distance,
       CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(levenshtein(a.value, b.value) AS DOUBLE)
         / CAST(greatest(length(a.value), length(b.value)) AS DOUBLE)) AS similarity
FROM v a JOIN v b ON a.block = b.block AND a.value < b.value
WHERE levenshtein(a.value, b.value) * CAST(100 AS DOUBLE) <= CAST(40 AS DOUBLE) * greatest(length(a.value), length(b.value))
""")
def link_fuzzy(spark, sf):
    """Similar part names (similarity >= 60) within a brand, over distinct values."""
    lk = Link("part", "p_name", "part", "p_name", kind="fuzzy", threshold=60, block_on=("p_brand", "p_brand"))
    return link_pairs({"part": table(spark, sf, "part")}, lk)


@register("link_semantic", f"""
WITH d AS (SELECT doc_id, lower(regexp_extract(text, '{EMAIL_RE}', 1)) AS dom FROM documents),
k AS (SELECT doc_id, CASE WHEN dom = '' THEN NULL ELSE dom END AS dom FROM d),
e AS (SELECT doc_id, CASE WHEN dom IS NULL THEN doc_id ELSE MIN(doc_id) OVER (PARTITION BY dom) END AS entity_id FROM k)
SELECT entity_id, MIN(doc_id) AS first_doc, MAX(doc_id) AS last_doc, COUNT(*) AS n_members
FROM e GROUP BY entity_id
""")
def link_semantic(spark, sf):
    """E3 + E7: documents linked by the e-mail domain found in their text, merged per entity."""
    lk = Link("documents", "text", "documents", "text", kind="semantic", derive="email_domain")
    return entity_merge({"documents": table(spark, sf, "documents")}, [lk], [
        M("first_doc", "min", ("documents", "doc_id")),
        M("last_doc", "max", ("documents", "doc_id")),
    ], ids={"documents": "doc_id"}, order_by={"documents": "doc_id"})


@register("unresolved_clusters", f"""
WITH RECURSIVE c AS (SELECT c_custkey AS id, {_K1} AS k1, {_K2} AS k2 FROM customer),
e AS (SELECT a.id AS s, b.id AS d FROM c a JOIN c b ON a.k1 = b.k1
      UNION SELECT a.id, b.id FROM c a JOIN c b ON a.k2 = b.k2),
r(s, d) AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s),
comp AS (SELECT s AS id, MIN(d) AS root FROM r GROUP BY s),
sized AS (SELECT id, root, COUNT(*) OVER (PARTITION BY root) AS size FROM comp)
SELECT 0 AS _src, id AS _row_id, root AS cluster_id, 'cluster too large' AS reason FROM sized WHERE size > 3
""")
def unresolved_clusters(spark, sf):
    """Q4: rows left unmerged because their OR-key cluster has more than 3 rows."""
    from ..operators.entities import resolve
    from ..operators.quality import unresolved_entities
    from ..spec import SourceField

    key_fields = [[SourceField("customer", "k1")], [SourceField("customer", "k2")]]
    nodes = resolve({"customer": _or_customers(spark, sf)}, [], [], ids={"customer": "c_custkey"},
                    key_fields=key_fields, max_cluster_size=3)
    return unresolved_entities(nodes)


@register("link_exact", """
WITH o AS (SELECT o_custkey, MIN(o_orderkey * 2 + 1) AS first_order_row, COUNT(*) AS n, 
                  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM orders GROUP BY o_custkey)
SELECT CASE WHEN o.o_custkey IS NULL THEN c.c_custkey * 2 ELSE LEAST(c.c_custkey * 2, o.first_order_row) END AS entity_id,
       c.c_name AS c_name, COALESCE(o.n, 0) + 1 AS n_members, COALESCE(o.total, 0) AS total
FROM customer c LEFT JOIN o ON c.c_custkey = o.o_custkey
""")
def link_exact(spark, sf):
    """E1 + E7: customers and orders linked by an exact key across sources, merged per entity."""
    orders = table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast(DEC))
    out = entity_merge({"customer": table(spark, sf, "customer"), "orders": orders},
                       [Link("customer", "c_custkey", "orders", "o_custkey")], [
                           M("c_name", "firstMatch", ("customer", "c_name")),
                           M("total", "sum", ("orders", "o_totalprice")),
                       ], ids={"customer": "c_custkey", "orders": "o_orderkey"})
    return _to_double(out, "total")


@register("fuzzy_entities", """
WITH RECURSIVE v AS (SELECT DISTINCT p_brand AS b, p_name AS n FROM part),
e AS (SELECT a.b AS b, a.n AS x, c.n AS y FROM v a JOIN v c ON a.b = c.b
      WHERE levenshtein(a.n, c.n) * 100 <= 25 * greatest(length(a.n), length(c.n))),
r(b, x, y) AS (SELECT b, x, y FROM e UNION SELECT r.b, r.x, e.y FROM r JOIN e ON r.b = e.b AND r.y = e.x),
g AS (SELECT b, x, MIN(y) AS grp FROM r GROUP BY b, x),
p AS (SELECT part.*, g.grp FROM part JOIN g ON part.p_brand = g.b AND part.p_name = g.x)
SELECT MIN(p_partkey) AS entity_id, COUNT(*) AS n_members, COUNT(DISTINCT p_name) AS n_names,
       MAX(p_retailprice) AS max_price
FROM p GROUP BY p_brand, grp
""")
def fuzzy_entities(spark, sf):
    """E2 + E4 + E7: parts of one brand whose names are >= 75% similar (transitively) form one entity."""
    lk = Link("part", "p_name", "part", "p_name", kind="fuzzy", threshold=75, block_on=("p_brand", "p_brand"))
    from ..spec import Policy

    out = entity_merge({"part": table(spark, sf, "part")}, [lk], [
        M("n_names", Policy("custom", func=lambda c: F.count_distinct(c)), ("part", "p_name")),
        M("max_price", "max", ("part", "p_retailprice")),
    ], ids={"part": "p_partkey"})
    return out.select("entity_id", "n_members", "n_names", "max_price")


@register("split_clusters", f"""
WITH RECURSIVE c AS (SELECT c_custkey AS id, {_K1} AS k1, {_K2} AS k2, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
l AS (SELECT i AS x, MIN(i) OVER (PARTITION BY k1) AS y, 0.5 AS w FROM c
      UNION ALL SELECT i, MIN(i) OVER (PARTITION BY k2), 0.8 FROM c),
e AS (SELECT least(x, y) AS a, greatest(x, y) AS b, MAX(w) AS w FROM l WHERE x <> y GROUP BY 1, 2),
o AS (SELECT a, b, row_number() OVER (ORDER BY w DESC, a, b) AS n FROM e),
s(n, labels) AS (
  SELECT 0::BIGINT, (SELECT list(i ORDER BY i) FROM c)
  UNION ALL
  SELECT o.n, CASE WHEN labels[a] <> labels[b] AND len(list_filter(labels, lambda x: x = labels[a] OR x = labels[b])) <= 5
                   THEN list_transform(labels, lambda x: CASE WHEN x = greatest(labels[a], labels[b]) THEN least(labels[a], labels[b]) ELSE x END)
                   ELSE labels END
  FROM s JOIN o ON o.n = s.n + 1),
f AS (SELECT labels FROM s ORDER BY n DESC LIMIT 1),
p AS (SELECT c.id, m.id AS entity_id FROM c CROSS JOIN f JOIN c m ON m.i = labels[c.i])
SELECT entity_id, MAX(id) AS last_customer, COUNT(*) AS n_members FROM p GROUP BY entity_id
""")
def split_clusters(spark, sf):
    """Clusters above five customers are cut at their weakest links, equal to taking the links one by one."""
    links = [Link("customer", "k1", "customer", "k1", weight=0.5), Link("customer", "k2", "customer", "k2", weight=0.8)]
    return entity_merge({"customer": _or_customers(spark, sf)}, links, [M("last_customer", "max", ("customer", "c_custkey"))],
                        ids={"customer": "c_custkey"}, max_cluster_size=5, oversize="split")


@register("link_two_columns", """
WITH RECURSIVE c AS (SELECT c_custkey AS id, c_custkey - c_nationkey AS into_id FROM customer),
r(id, seen) AS (SELECT id, id FROM c
                UNION SELECT r.id, c.into_id FROM r JOIN c ON c.id = r.seen JOIN c p ON p.id = c.into_id),
f AS (SELECT id, MIN(seen) AS entity_id FROM r GROUP BY id)
SELECT entity_id, MAX(id) AS last_customer, COUNT(*) AS n_members FROM f GROUP BY entity_id
""")
def link_two_columns(spark, sf):
    """Customers linked to the one that their own row names, two columns of one source."""
    c = table(spark, sf, "customer").withColumn("merged_into", F.col("c_custkey") - F.col("c_nationkey"))
    return entity_merge({"customer": c}, [Link("customer", "merged_into", "customer", "c_custkey")],
                        [M("last_customer", "max", ("customer", "c_custkey"))], ids={"customer": "c_custkey"})


_NEW_CUSTOMER = """(SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 40 ELSE c_acctbal END AS c_acctbal
                   FROM customer WHERE c_nationkey <> 7)"""


@register("remerge_or", _OR_ORACLE.format(entity="sized.root").replace("FROM customer)", f"FROM {_NEW_CUSTOMER})"))
def remerge_or_q(spark, sf):
    """I1 for OR keys: one nation's customers go, another's come, a segment's balances (a key) change; equal to a full merge."""
    from ..operators.incremental import or_state, remerge_or

    c = table(spark, sf, "customer")
    building = F.col("c_mktsegment") == "BUILDING"
    new = c.filter("c_nationkey <> 7").withColumn("c_acctbal", F.when(building, F.col("c_acctbal") + 40).otherwise(F.col("c_acctbal")))
    shape = [F.expr(_K1).alias("k1"), F.expr(_K2).alias("k2"), F.col("c_acctbal").cast(DEC).alias("c_acctbal")]
    old, new = ({"customer": d.select("c_custkey", *shape)} for d in (c.filter("c_nationkey <> 5"), new))
    ids, order = {"customer": "c_custkey"}, {"customer": "c_custkey"}
    before, state = merge(old, _or_spec(), ids=ids, order_by=order), or_state(old, _or_spec(), ids)
    changes = c.filter(building | F.col("c_nationkey").isin(5, 7)).select("c_custkey")
    return _to_double(remerge_or(before, state, new, _or_spec(), {"customer": changes}, ids, order)[0], "total_bal")


@register("entity_links", """
WITH c AS (SELECT c_custkey * 2 AS id, c_custkey AS k FROM customer),
o AS (SELECT o_orderkey * 2 + 1 AS id, o_custkey AS k, o_orderkey FROM orders),
n AS (SELECT id, k, 0 AS side FROM c UNION ALL SELECT id, k, 1 FROM o),
s AS (SELECT k, MIN(id) AS first FROM n GROUP BY k HAVING MIN(side) = 0 AND MAX(side) = 1)
SELECT first AS entity_id, id AS _row_id, first AS parent, 0 AS link, CAST(k AS VARCHAR) AS value, 1 AS depth
FROM n JOIN s USING (k) WHERE id <> first
""")
def entity_links(spark, sf):
    """Q5: for each customer and order that is not the first row of its entity, the link that joins it to one nearer to that."""
    from ..operators.evidence import explain_entities

    sources = {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}
    return explain_entities(sources, [Link("customer", "c_custkey", "orders", "o_custkey")], ids={"customer": "c_custkey", "orders": "o_orderkey"})


@register("entity_links_or", """
WITH RECURSIVE c AS (SELECT c_custkey AS id, c_nationkey, c_custkey - c_nationkey AS into_id FROM customer),
e AS (SELECT c.id, c.into_id AS parent FROM c JOIN c p ON p.id = c.into_id WHERE c.into_id <> c.id),
v AS (SELECT parent AS k, id, 0 AS side FROM e UNION ALL SELECT parent, parent, 1 FROM e),
r(id, at_id, depth) AS (SELECT id, parent, 1 FROM e UNION ALL SELECT r.id, e.parent, depth + 1 FROM r JOIN e ON e.id = r.at_id)
SELECT MIN(at_id) AS entity_id, r.id AS _row_id, e.parent, 0 AS link, CAST(e.parent AS VARCHAR) AS value, CAST(MAX(depth) AS INTEGER) AS depth
FROM r JOIN e ON e.id = r.id GROUP BY r.id, e.parent
""")
def entity_links_or(spark, sf):
    """Q5: chains of customers, each linked to the one that its row names: parents and number of links to the first."""
    from ..operators.evidence import explain_entities

    c = table(spark, sf, "customer").withColumn("merged_into", F.col("c_custkey") - F.col("c_nationkey"))
    return explain_entities({"customer": c}, [Link("customer", "merged_into", "customer", "c_custkey")], ids={"customer": "c_custkey"})
