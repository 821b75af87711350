"""Quality reports, incremental re-merge, readers/sinks, SQL mode, predicates, spec parsing."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from keymerge import (Mapping, MergeSpec, Policy, SourceDef, SourceField, SpecError, load_source, merge,
                      parse_source, payload_csv, preview, read_csv, write)
from keymerge.functions.predicates import (Contains, Equals, Expr, GreaterThan, IsNotNull, IsNull, LessThan, Not,
                                           Regex, filter_rows, from_dict)
from keymerge.operators.incremental import changed_keys, remerge, remerge_changed
from keymerge.operators.quality import coverage, lineage, unresolved
from keymerge.plans.sqlmode import sql


def M(dest, policy, *fields, **kw):
    return Mapping(dest, Policy(policy, **kw), tuple(SourceField(s, c) for s, c in fields))


@pytest.fixture
def two(spark):
    a = spark.createDataFrame([(1, "ann"), (2, ""), (3, "cy"), (None, "nk")], "k long, name string")
    b = spark.createDataFrame([(1, "10"), (1, "x"), (4, "7")], "k long, amt string")
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("B", "k")), M("name", "firstMatch", ("A", "name")),
                                   M("amt", "sum", ("B", "amt"))])
    return {"A": a, "B": b}, spec


def test_unresolved_reasons(two):
    src, spec = two
    got = {(r["source"], r["k"], r["field"], r["reason"], r["n_rows"]) for r in unresolved(src, spec).collect()}
    assert got == {("A", 2, None, "no match in B", 1), ("A", 3, None, "no match in B", 1),
                   ("B", 4, None, "no match in A", 1), ("A", None, None, "null key", 1),
                   ("A", 2, "A.name", "empty field", 1), ("B", 1, "B.amt", "type mismatch", 1)}


def test_lineage_and_coverage(two, spark):
    src, spec = two
    lin = lineage(src, spec, order_by={"A": "k", "B": "amt"})
    got = sorted((r["k"], r["field"], r["value"], r["merged"]) for r in lin.collect())
    assert (1, "name", "ann", "ann") in got
    assert sorted(v for k, f, v, m in got if f == "amt") == ["10", "x"]
    cov = {(r["source"], r["column"]): (r["used_by"], r["n_rows"], r["n_values"]) for r in coverage(src, spec).collect()}
    assert cov[("A", "k")] == ("k", 4, 3)
    assert cov[("B", "amt")] == ("amt", 3, 3)
    bad = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k")), M("z", "sum", ("A", "nope"))])
    rows = {r["column"]: (r["present"], r["n_values"]) for r in coverage(src, bad).collect()}
    assert rows == {"k": (True, 3), "nope": (False, None)}


def test_remerge_equals_full_merge(spark):
    a = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "k long, name string")
    old = spark.createDataFrame([(i % 20, i) for i in range(60)], "k long, v long")
    new = old.withColumn("v", F.when(F.col("k") == 3, F.col("v") + 100).otherwise(F.col("v"))) \
        .filter(F.col("k") != 5).unionByName(spark.createDataFrame([(7, 1000)], "k long, v long"))
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("B", "k")), M("s", "sum", ("B", "v")),
                                   M("n", "count", ("B", "v"))])
    prev = merge({"A": a, "B": old}, spec, how="left")
    inc = remerge(prev, {"A": a, "B": old}, {"A": a, "B": new}, spec, changed=["B"], how="left")
    full = merge({"A": a, "B": new}, spec, how="left")
    assert sorted(map(tuple, inc.collect())) == sorted(map(tuple, full.collect()))
    ks = sorted(r["k"] for r in changed_keys(spec, "B", old, new).collect())
    assert ks == [3, 5, 7]
    keys = spark.createDataFrame([(3,)], "k long")
    again = remerge_changed(prev, {"A": a, "B": new}, spec, keys, how="left")
    assert again.count() == 20


def test_csv_tsv_roundtrip_and_preview(spark):
    df = spark.createDataFrame([(i, f"n{i}", i * 1.5, i % 2 == 0) for i in range(50)], "id long, s string, x double, b boolean")
    for fmt, reader in (("csv", read_csv), ("tsv", lambda sp, p: read_csv(sp, p, sep="\t"))):
        d = os.path.join(tempfile.mkdtemp(prefix="km-io-"), "out")
        write(df, d, fmt)
        back = reader(spark, d)
        assert back.dtypes == [("id", "bigint"), ("s", "string"), ("x", "double"), ("b", "boolean")]
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    page = preview(df, 5, offset=10, order_by=["id"]).collect()
    assert [r["id"] for r in page] == list(range(10, 15))
    assert preview(df, 3).count() == 3
    with pytest.raises(SpecError):
        preview(df, 3, offset=2)
    with pytest.raises(SpecError, match="Unsupported format"):
        write(df, "/nonexistent", "xlsx")


def test_load_source_and_errors(spark):
    d = tempfile.mkdtemp(prefix="km-src-")
    p = os.path.join(d, "customers.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("\ufeffid,name\n1,Ann\n2,Bob")
    df = load_source(spark, f"customers:{p}")
    assert df.dtypes == [("id", "bigint"), ("name", "string")] and df.count() == 2
    assert parse_source("o:/x/orders.tsv").format == "tsv"
    with pytest.raises(SpecError, match="File not found"):
        load_source(spark, SourceDef("z", os.path.join(d, "missing.csv")))
    with pytest.raises(SpecError, match="Unsupported format: XLSX"):
        load_source(spark, SourceDef("z", p, "XLSX"))


def test_payload_csv(spark):
    df = spark.createDataFrame([(1, "a,b\n1,x\n2,y"), (2, "a,b\n3,z\n")], "id long, payload string")
    rows = payload_csv(df, "payload", "a INT, b STRING", keep=["id"]).collect()
    assert sorted((r["id"], r["a"], r["b"]) for r in rows) == [(1, 1, "x"), (1, 2, "y"), (2, 3, "z")]


def test_sql_mode(spark):
    a = spark.createDataFrame([(1, 5), (2, 7)], "k long, v long")
    assert sql({"tbl_a": a}, "SELECT SUM(v) AS s FROM tbl_a").first()["s"] == 12
    with pytest.raises(SpecError, match="SQL query cannot be empty"):
        sql({"tbl_a": a}, "  ")


def test_predicates(spark):
    df = spark.createDataFrame([(1, "active", "ab12", 3.5, ""), (2, "idle", "zz", 10.0, None), (3, "active", "q9", 1.0, "x")],
                               "id long, status string, code string, score double, note string")

    def ids(p):
        return sorted(r["id"] for r in filter_rows(df, p).collect())

    assert ids(Equals("id", "2")) == [2]
    assert ids(Contains("code", "b1")) == [1]
    assert ids(Regex("code", "^[a-z][0-9]$")) == [3]
    assert ids(IsNull("note")) == [1, 2]
    assert ids(IsNotNull("note")) == [3]
    assert ids(GreaterThan("score", "2") & LessThan("score", "5")) == [1]
    assert ids(Not(Equals("status", "active")) | Equals("id", "1")) == [1, 2]
    assert ids(Expr("status = 'active'")) == [1, 3]
    assert ids("score > 2") == [1, 2]
    p = from_dict({"And": [{"GreaterThan": {"column": "score", "value": "2"}}, {"Not": {"Equals": {"column": "id", "value": "2"}}}]})
    assert ids(p) == [1]


def test_spec_from_dict_dialects():
    flat = {"sources": [{"id": "c", "path": "c.csv", "format": "csv"}],
            "destination_schema": [{"name": "id", "data_type": "Int64"}, {"name": "total", "data_type": "Float64"}],
            "primary_keys": {"logic": "or", "keys": ["id"]},
            "mappings": [{"destination_field": "id", "policy": {"type": "firstMatch", "priority": ["c"]},
                          "source_fields": [{"source_file_id": "c", "column_name": "cid"}]},
                         {"destination_field": "total", "policy": {"type": "sum"},
                          "source_fields": [{"id": "t", "source_file_id": "c", "column_name": "amt"}]}]}
    s1 = MergeSpec.from_dict(flat)
    s2 = MergeSpec.from_dict({"query": flat})
    tagged = dict(flat, sources=[{"File": {"id": "c", "path": "c.csv", "format": "csv"}}])
    s3 = MergeSpec.from_dict({"query": tagged})
    for s in (s1, s2, s3):
        assert s.keys == ["id"] and s.logic == "or" and s.sources[0].id == "c"
        assert [m.policy.kind for m in s.mappings] == ["firstMatch", "sum"]
    with pytest.raises(SpecError, match="Unknown merge policy"):
        Policy("median")


def test_run_plan_readme_example(spark):
    from keymerge.plans.run import run_plan

    d = tempfile.mkdtemp(prefix="km-plan-")
    with open(os.path.join(d, "customers.csv"), "w") as fh:
        fh.write("id,name,email\n1,John Doe,john@example.com\n2,Jane Smith,jane@example.com\n3,Bob Johnson,bob@example.com\n")
    with open(os.path.join(d, "orders.csv"), "w") as fh:
        fh.write("customer_id,order_total,product\n1,99.99,Widget A\n2,149.50,Widget B\n1,25.00,Widget C\n")
    fp = lambda fid, src, col: {"id": fid, "source_file_id": src, "column_name": col}
    plan = {
        "sources": [{"id": "customers", "path": "customers.csv", "format": "csv"},
                    {"id": "orders", "path": "orders.csv", "format": "csv"}],
        "query": {"type": "dsl",
                  "destination_schema": [{"name": "customer_id", "data_type": "Int64"},
                                         {"name": "customer_name", "data_type": "String"},
                                         {"name": "email", "data_type": "String"},
                                         {"name": "total_spent", "data_type": "Float64"}],
                  "primary_keys": {"logic": "or", "keys": ["customer_id"]},
                  "mappings": [
                      {"destination_field": "customer_id", "policy": {"type": "firstMatch", "priority": ["customers"]},
                       "source_fields": [fp("a", "customers", "id"), fp("b", "orders", "customer_id")]},
                      {"destination_field": "customer_name", "policy": {"type": "firstMatch"},
                       "source_fields": [fp("c", "customers", "name")]},
                      {"destination_field": "email", "policy": {"type": "firstMatch"},
                       "source_fields": [fp("d", "customers", "email")]},
                      {"destination_field": "total_spent", "policy": {"type": "sum"},
                       "source_fields": [fp("e", "orders", "order_total")]}]}}
    out = run_plan(spark, plan, base_dir=d, how="left")
    got = sorted((r["customer_id"], r["customer_name"], round(r["total_spent"], 2)) for r in out.collect())
    assert got == [(1, "John Doe", 124.99), (2, "Jane Smith", 149.5), (3, "Bob Johnson", 0.0)]
    q = run_plan(spark, {"sources": plan["sources"], "query": {"type": "sql",
                                                               "sql": "SELECT COUNT(*) AS n FROM orders"}}, base_dir=d)
    assert q.first()["n"] == 3


def test_messy_headers(spark):
    """Headers with dots, spaces and dashes work everywhere (dots are not struct access)."""
    from keymerge.operators.types import profile

    d = tempfile.mkdtemp(prefix="km-messy-")
    p = os.path.join(d, "o.csv")
    with open(p, "w") as fh:
        fh.write("order id,unit.price,e-mail\n1,2.5,a@x.org\n1,1.5,\n2,4,b@y.org\n")
    df = read_csv(spark, p)
    assert df.dtypes == [("order id", "bigint"), ("unit.price", "double"), ("e-mail", "string")]
    cust = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    spec = MergeSpec.build(["id"], [M("id", "firstMatch", ("c", "id"), ("o.csv", "order id")),
                                    M("total", "sum", ("o.csv", "unit.price")),
                                    M("mail", "firstMatch", ("o.csv", "e-mail"))])
    src = {"c": cust, "o.csv": df}
    got = sorted((r["id"], r["total"], r["mail"]) for r in merge(src, spec).collect())
    assert got == [(1, 4.0, "a@x.org"), (2, 4.0, "b@y.org")]
    assert filter_rows(df, GreaterThan("unit.price", "2")).count() == 2
    assert {r["semantic_type"] for r in profile(df, ["e-mail"]).collect()} == {"email"}
    assert lineage(src, spec, order_by={"c": "id", "o.csv": "unit.price"}).count() == 3 + 3
    assert {r["reason"] for r in unresolved(src, spec).collect()} == {"empty field"}


def test_unresolved_three_sources(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    b = spark.createDataFrame([(2,), (3,), (3,)], "k long")
    c = spark.createDataFrame([(3,), (4,)], "k long")
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("A", "k"), ("B", "k"), ("C", "k"))])
    got = {(r["source"], r["k"], r["reason"], r["n_rows"]) for r in unresolved({"A": a, "B": b, "C": c}, spec).collect()}
    assert got == {("A", 1, "no match in B", 1), ("A", 1, "no match in C", 1), ("A", 2, "no match in C", 1),
                   ("B", 2, "no match in C", 1), ("C", 4, "no match in A", 1), ("C", 4, "no match in B", 1)}


def test_preview_text(spark):
    from keymerge.sources import preview_text

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    text = preview_text(df, 1)
    assert "id" in text and "only showing top 1 row" in text


def test_cli_preview_and_write(spark, capsys):
    import json

    from keymerge.__main__ import main

    d = tempfile.mkdtemp(prefix="km-cli-")
    with open(os.path.join(d, "c.csv"), "w") as fh:
        fh.write("id,name\n1,Ann\n2,Bob\n")
    with open(os.path.join(d, "o.csv"), "w") as fh:
        fh.write("cid,amt\n1,2.5\n1,1.5\n3,9\n")
    fld = lambda s, c: {"source_file_id": s, "column_name": c}
    plan = {"sources": [{"id": "c", "path": "c.csv", "format": "csv"}, {"id": "o", "path": "o.csv", "format": "csv"}],
            "query": {"type": "dsl", "primary_keys": {"logic": "and", "keys": ["id"]},
                      "destination_schema": [{"name": "id"}, {"name": "name"}, {"name": "total"}],
                      "mappings": [{"destination_field": "id", "source_fields": [fld("c", "id"), fld("o", "cid")]},
                                   {"destination_field": "name", "source_fields": [fld("c", "name")]},
                                   {"destination_field": "total", "policy": {"type": "sum"},
                                    "source_fields": [fld("o", "amt")]}]}}
    pj = os.path.join(d, "plan.json")
    with open(pj, "w") as fh:
        json.dump(plan, fh)
    assert main([pj, "--preview", "--how", "left"]) == 0
    out = capsys.readouterr().out
    assert "Ann" in out and "Bob" in out
    assert main([pj, "-o", os.path.join(d, "out"), "-f", "tsv"]) == 0
    back = read_csv(spark, os.path.join(d, "out"), sep="\t")
    assert sorted(map(tuple, back.collect())) == [(1, "Ann", 4.0)]
