"""Merge semantics: the reference's fixtures plus plan-equivalence checks."""

import random

import pytest
from pyspark.sql import functions as F

from keymerge.plans.explain import plan_text
from keymerge import Mapping, MergeSpec, Policy, SourceField, SpecError, merge


def M(dest, policy, *fields, **kw):
    return Mapping(dest, policy if isinstance(policy, Policy) else Policy(policy, **kw),
                   tuple(SourceField(s, c) for s, c in fields))


@pytest.fixture
def readme(spark):
    cust = spark.createDataFrame([(1, "John Doe", "john@example.com"), (2, "Jane Smith", "jane@example.com"),
                                  (3, "Bob Johnson", "bob@example.com")], "id long, name string, email string")
    orders = spark.createDataFrame([(1, 99.99, "Widget A"), (2, 149.50, "Widget B"), (1, 25.00, "Widget C")],
                                   "customer_id long, order_total double, product string")
    spec = MergeSpec.build(["customer_id"], [
        M("customer_id", Policy("firstMatch", ("customers",)), ("customers", "id"), ("orders", "customer_id")),
        M("customer_name", Policy("firstMatch", ("customers",)), ("customers", "name")),
        M("email", "firstMatch", ("customers", "email")),
        M("total_spent", "sum", ("orders", "order_total")),
    ])
    return {"customers": cust, "orders": orders}, spec


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_readme_left_merge_keeps_unmatched_with_zero(readme):
    src, spec = readme
    out = merge(src, spec, how="left")
    assert out.columns == ["customer_id", "customer_name", "email", "total_spent"]
    got = rows(out, "customer_id", "customer_name", "email", "total_spent")
    assert got == [(1, "John Doe", "john@example.com", pytest.approx(124.99)),
                   (2, "Jane Smith", "jane@example.com", 149.5),
                   (3, "Bob Johnson", "bob@example.com", 0.0)]


def test_readme_inner_merge_drops_unmatched(readme):
    src, spec = readme
    assert [r[0] for r in rows(merge(src, spec), "customer_id")] == [1, 2]


def test_all_policies_fixture(spark):
    cust = spark.createDataFrame([(i, n) for i, n in enumerate(["Alice", "Bob", "Charlie", "Diana", "Eve"], 1)],
                                 "id long, name string")
    orders = spark.createDataFrame([(1, 199.0), (1, 49.99), (2, 100.0), (2, 49.49), (3, 49.99), (4, 299.99), (5, 29.99)],
                                   "customer_id long, total double")
    spec = MergeSpec.build(["id"], [
        M("id", "firstMatch", ("c", "id"), ("o", "customer_id")),
        M("name", "firstMatch", ("c", "name")),
        M("total_value", "sum", ("o", "total")),
        M("order_count", "count", ("o", "total")),
    ])
    got = rows(merge({"c": cust, "o": orders}, spec), "id", "name", "total_value", "order_count")
    assert [(a, b, round(c, 2), d) for a, b, c, d in got] == [
        (1, "Alice", 248.99, 2), (2, "Bob", 149.49, 2), (3, "Charlie", 49.99, 1), (4, "Diana", 299.99, 1),
        (5, "Eve", 29.99, 1)]


def test_primary_order_kept(spark):
    a = spark.createDataFrame([(100, "Alice", 30), (200, "Bob", 25), (300, "Charlie", 35), (150, "Frank", 28),
                               (250, "Eve", 22)], "cid long, name string, age long").coalesce(1)
    b = spark.createDataFrame([(250, "e@x", "P"), (100, "a@x", "L"), (150, "f@x", "B"), (200, "b@x", "N"),
                               (300, "c@x", "T")], "customer_id long, email string, city string").coalesce(1)
    spec = MergeSpec.build(["id"], [
        M("id", "firstMatch", ("A", "cid"), ("B", "customer_id")),
        M("name", "firstMatch", ("A", "name")),
        M("email", "firstMatch", ("B", "email")),
        M("age", "max", ("A", "age")),
    ])
    out = merge({"A": a, "B": b}, spec, keep_order=True).collect()
    assert [r["id"] for r in out] == [100, 200, 300, 150, 250]
    assert [r["name"] for r in out] == ["Alice", "Bob", "Charlie", "Frank", "Eve"]


def test_priority_dedup_inner(spark):
    a = spark.createDataFrame([(1001, 100.50), (1002, 200.75), (1003, 150.00)], "order_id long, amount double")
    b = spark.createDataFrame([(1002, 999.99), (1004, 300.25), (1005, 450.00)], "order_number long, price double")
    spec = MergeSpec.build(["order_id"], [
        M("order_id", Policy("firstMatch", ("A",)), ("A", "order_id"), ("B", "order_number")),
        M("amount", Policy("firstMatch", ("A",)), ("B", "price"), ("A", "amount")),
    ])
    assert rows(merge({"A": a, "B": b}, spec), "order_id", "amount") == [(1002, 200.75)]


def test_secondary_rows_appended_in_full_merge(spark):
    a = spark.createDataFrame([(101, "Widget A"), (103, "Widget C")], "pid long, name string").coalesce(1)
    b = spark.createDataFrame([(102, "d2"), (103, "d3"), (104, "d4")], "product_id long, description string").coalesce(1)
    spec = MergeSpec.build(["pid"], [
        M("pid", "firstMatch", ("A", "pid"), ("B", "product_id")),
        M("name", "firstMatch", ("A", "name")),
        M("description", "firstMatch", ("B", "description")),
    ])
    out = merge({"A": a, "B": b}, spec, how="full", keep_order=True).collect()
    assert [(r["pid"], r["name"]) for r in out] == [(101, "Widget A"), (103, "Widget C"), (102, None), (104, None)]


def test_three_way_left_and_full(spark):
    a = spark.createDataFrame([(5, "eve"), (1, "alice"), (3, "charlie")], "uid long, username string").coalesce(1)
    b = spark.createDataFrame([(2, "b@x"), (1, "a@x"), (4, "d@x")], "user_id long, email string").coalesce(1)
    c = spark.createDataFrame([(1, "111"), (6, "666"), (3, "333")], "id long, phone string").coalesce(1)
    spec = MergeSpec.build(["uid"], [
        M("uid", "firstMatch", ("A", "uid"), ("B", "user_id"), ("C", "id")),
        M("username", "firstMatch", ("A", "username")),
        M("email", "firstMatch", ("B", "email")),
        M("phone", "firstMatch", ("C", "phone")),
    ])
    left = merge({"A": a, "B": b, "C": c}, spec, how="left", keep_order=True).collect()
    assert [(r["uid"], r["username"]) for r in left] == [(5, "eve"), (1, "alice"), (3, "charlie")]
    assert [(r["email"], r["phone"]) for r in left] == [(None, None), ("a@x", "111"), (None, "333")]
    full = merge({"A": a, "B": b, "C": c}, spec, how="full", keep_order=True).collect()
    assert [r["uid"] for r in full][:3] == [5, 1, 3]
    assert sorted(r["uid"] for r in full) == [1, 2, 3, 4, 5, 6]


ALL = ["firstMatch", "lastMatch", "first_row", "sum", "count", "count_rows", "average", "min", "max", "row_sum",
       "row_means", "values", "coalesced_values", "concat"]


def _random_sources(spark, seed):
    rnd = random.Random(seed)

    def gen(n, nk):
        return [(rnd.randint(0, nk), rnd.choice([None, rnd.randint(-5, 20)]), rnd.choice([None, rnd.randint(0, 9)]), i)
                for i in range(n)]

    schema = "k long, x long, y long, o long"
    return {s: spark.createDataFrame(gen(n, 12), schema) for s, n in (("A", 30), ("B", 25), ("C", 20))}


def _spec_all():
    maps = [M("k", "firstMatch", ("A", "k"), ("B", "k"), ("C", "k"))]
    for p in ALL:
        maps.append(M(f"{p}_ab", p, ("A", "x"), ("B", "y"), ("C", "x")))
        maps.append(M(f"{p}_a", p, ("A", "y")))
    return MergeSpec.build(["k"], maps)


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_preaggregated_plan_equals_row_join(spark, how):
    """The default plan (per-source aggregates + multipliers) equals grouping the row-level join."""
    src = _random_sources(spark, 7)
    spec = _spec_all()
    order = {s: "o" for s in src}
    a = merge(src, spec, how=how, order_by=order)
    b = merge(src, spec, how=how, order_by=order, plan="rowjoin")
    ca = sorted(map(tuple, a.collect()), key=repr)
    cb = sorted(map(tuple, b.select(*a.columns).collect()), key=repr)
    assert ca == cb


def test_safe_equals_rows_when_sources_unique(spark):
    src = _random_sources(spark, 3)
    uniq = {s: df.dropDuplicates(["k"]) for s, df in src.items()}
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("B", "k")),
                                   M("s", "sum", ("A", "x"), ("B", "y")), M("n", "count_rows", ("A", "x"))])
    a = sorted(map(tuple, merge(uniq, spec, fanout="rows").collect()))
    b = sorted(map(tuple, merge(uniq, spec, fanout="safe").collect()))
    assert a == b


def test_safe_fanout_counts_each_row_once(spark):
    a = spark.createDataFrame([(1, 10), (1, 20)], "k long, x long")
    b = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "k long, y long")
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("B", "k")), M("sx", "sum", ("A", "x")),
                                   M("n", "count_rows", ("B", "y"))])
    assert rows(merge({"A": a, "B": b}, spec, fanout="rows"), "sx", "n") == [(90, 6)]
    assert rows(merge({"A": a, "B": b}, spec, fanout="safe"), "sx", "n") == [(30, 3)]


def test_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 2), (None, 3)], "k long, x long")
    b = spark.createDataFrame([(None, 5), (1, 6)], "k long, y long")
    two = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("B", "k")), M("s", "sum", ("A", "x"))])
    assert rows(merge({"A": a, "B": b}, two, how="full"), "k", "s") == [(1, 2)]
    one = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k")), M("s", "sum", ("A", "x"))])
    assert rows(merge({"A": a}, one), "k", "s") == [(1, 2), (None, 4)]


def test_composite_key_and_rows_mode(spark):
    a = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "k1 long, k2 string, v long")
    b = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (2, "b", 3)], "x long, y string, w long")
    spec = MergeSpec.build(["k1", "k2"], [
        M("k1", "firstMatch", ("A", "k1"), ("B", "x")), M("k2", "firstMatch", ("A", "k2"), ("B", "y")),
        M("v", "sum", ("A", "v")), M("w", "sum", ("B", "w"))])
    assert rows(merge({"A": a, "B": b}, spec), "k1", "k2", "v", "w") == [(1, "a", 5, 1), (2, "a", 7, 2)]
    flat = merge({"A": a, "B": b}, spec, dedupe=False)
    assert rows(flat, "k1", "k2", "v", "w") == [(1, "a", 5, 1), (2, "a", 7, 2)]


def test_custom_policy_and_passthrough(spark):
    a = spark.createDataFrame([(1, "x", "seg1"), (1, "y", "seg1"), (1, "x", "seg1"), (2, "z", "seg2")],
                              "k long, v string, segment string")
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k")),
                                   M("nd", Policy("custom", func=lambda c: F.count_distinct(c)), ("A", "v"))],
                           destination=["k", "segment", "nd"])
    assert rows(merge({"A": a}, spec), "k", "segment", "nd") == [(1, "seg1", 2), (2, "seg2", 1)]


def test_declared_cast(spark):
    a = spark.createDataFrame([(1, "12"), (2, "x")], "k long, v string")
    from keymerge.spec import DestField

    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k")), M("v", "firstMatch", ("A", "v"))],
                           destination=[DestField("k", "Int64"), DestField("v", "Integer")])
    assert rows(merge({"A": a}, spec, cast=True), "k", "v") == [(1, 12), (2, None)]


def test_validation_errors(spark):
    a = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(SpecError, match="unknown source: Z"):
        merge({"A": a}, MergeSpec.build(["k"], [M("k", "firstMatch", ("Z", "k"))]))
    with pytest.raises(SpecError, match="No mapping found for primary key: q"):
        merge({"A": a}, MergeSpec.build(["q"], [M("k", "firstMatch", ("A", "k"))], destination=["q", "k"]))
    with pytest.raises(SpecError, match="unknown destination field"):
        merge({"A": a}, MergeSpec.build(["q"], [M("k", "firstMatch", ("A", "k"))], destination=["k"]))
    with pytest.raises(SpecError, match="may not contain"):
        merge({"A": a}, MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k")), M("x.y", "sum", ("A", "k"))]))
    with pytest.raises(SpecError, match="order_by names unknown sources: Q"):
        merge({"A": a}, MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"))]), order_by={"Q": "k"})
    with pytest.raises(SpecError, match="appears twice"):
        merge({"A": a}, MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("A", "k"))]))


def test_plan_shape_two_exchanges(spark):
    """Two sources: one exchange per source aggregate, none added for the join."""
    a = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"))
    b = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("y"))
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("B", "k")), M("sx", "sum", ("A", "x")),
                                   M("sy", "sum", ("B", "y"))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(merge({"A": a, "B": b}, spec))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_default_order_follows_files(spark, tmp_path):
    """Without order_by, 'first' follows (file path, position) for a multi-file source."""
    d = str(tmp_path / "src")
    for i, rows in enumerate([[(1, "a0"), (1, "a1")], [(1, "b0")] * 50, [(2, "c0")]]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(f"{d}/part={i}")
    src = spark.read.parquet(d)
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("S", "k")), M("first", "first_row", ("S", "v")),
                                   M("last", "lastMatch", ("S", "v"))])
    got = {r["k"]: (r["first"], r["last"]) for r in merge({"S": src}, spec).collect()}
    assert got == {1: ("a0", "b0"), 2: ("c0", "c0")}


def test_plan_shape_full_merge_three_sources(spark):
    """Full merge of 3 sources: one exchange per source, none after (union + group-by, no join chain)."""
    from keymerge.plans.explain import plan_report

    a = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("x"))
    b = spark.range(1000).select((F.col("id") + 500).alias("k"), F.col("id").alias("y"))
    c = spark.range(1000).select((F.col("id") + 900).alias("k"), F.col("id").alias("z"))
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("B", "k"), ("C", "k")),
                                   M("sx", "sum", ("A", "x")), M("sy", "sum", ("B", "y")), M("sz", "sum", ("C", "z"))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = merge({"A": a, "B": b, "C": c}, spec, how="full")
        r = plan_report(df)
        assert df.count() == 1900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert r["shuffles"] == 3 and r["sort_merge_joins"] == 0
