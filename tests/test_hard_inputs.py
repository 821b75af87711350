"""Inputs that once gave wrong answers: each case against a plain computation."""

import os
import random

import pytest
from pyspark.sql import functions as F

from keymerge import Mapping, MergeSpec, Policy, SourceField, merge, sql
from keymerge.functions.predicates import filter_rows, from_dict
from keymerge.operators.entities import ROW_ID, Link, _candidates, _value_star_edges, entity_merge, similar_values
from keymerge.operators.incremental import remerge
from keymerge.operators.quality import unresolved
from keymerge.operators.types import apply_types, infer_column_types
from keymerge.plans.explain import plan_text
from keymerge.plans.run import run_plan
from keymerge.sources import load_source, read_csv, write
from keymerge.spec import SpecError, register_function


def M(dest, policy, *fields):
    return Mapping(dest, Policy(policy) if isinstance(policy, str) else policy, tuple(SourceField(*f) for f in fields))


# ---------------------------------------------------------------- types
def test_types_are_lossless(spark):
    rows = [("1234567890123456789", "99999999999999999999", "9007199254740993"), ("1234567890123456788", "1", "0.5")]
    raw = spark.createDataFrame(rows, "a string, b string, c string")
    assert infer_column_types(raw) == {"a": "bigint", "b": "string", "c": "string"}
    assert sorted(r.a for r in apply_types(raw).collect()) == [1234567890123456788, 1234567890123456789]


def test_sampled_types_are_checked(spark):
    raw = spark.createDataFrame([("1", "true")] * 5 + [("x7", "maybe")], "a string, b string").coalesce(1)
    with pytest.raises(Exception, match="not a bigint: x7"):
        apply_types(raw, sample=5).collect()
    last = apply_types(raw, sample=5, on_mismatch="flag").collect()[-1]
    assert (last.a, last.a__mismatch, last.b, last.b__mismatch) == (None, True, None, True)
    assert apply_types(raw.limit(1), schema_hint={"a": "Int64"}).dtypes[0] == ("a", "bigint")


# ---------------------------------------------------------------- re-merge
@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_remerge_equals_full_merge_in_scan_order(spark, tmpdir_path, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rng = random.Random(1)
        path = os.path.join(tmpdir_path, f"s{broadcast}")
        spark.createDataFrame([(rng.randrange(1000), i) for i in range(6000)], "k long, v long").coalesce(1).write.parquet(path)
        old = spark.read.parquet(path)
        new = old.withColumn("v", F.when(F.col("k") < 500, F.col("v") + 100_000).otherwise(F.col("v")))
        spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("s", "k")), M("f", "firstMatch", ("s", "v")), M("l", "lastMatch", ("s", "v"))])
        got = remerge(merge({"s": old}, spec), {"s": old}, {"s": new}, spec).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, merge({"s": new}, spec).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


# ---------------------------------------------------------------- keys and order
def test_null_and_tied_order_values(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (2, 5, "x"), (2, 5, "y")], "k long, o long, v string").coalesce(1)
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("s", "k")), M("f", "firstMatch", ("s", "v")), M("r", "first_row", ("s", "v"))])
    got = {r.k: (r.f, r.r) for r in merge({"s": df}, spec, order_by={"s": "o"}).collect()}
    assert got == {1: ("a", "a"), 2: ("x", "x")}


def test_or_key_fed_by_two_columns(spark):
    a = spark.createDataFrame([(1, "p", "q"), (2, "q", "r"), (3, "z", None), (4, None, "r")], "id long, e1 string, e2 string")
    spec = MergeSpec.build(["e"], [M("e", "firstMatch", ("a", "e1"), ("a", "e2")), M("n", "count", ("a", "id"))], logic="or")
    assert sorted((r.e, r.n) for r in merge({"a": a}, spec, ids={"a": "id"}).collect()) == [("p", 3), ("z", 1)]
    with pytest.raises(SpecError, match="do not apply"):
        merge({"a": a}, spec, how="left")


def test_or_keys_compare_numbers_as_numbers(spark):
    a = spark.createDataFrame([(1, 1, 7)], "id long, x long, y long")
    b = spark.createDataFrame([(5, 1.0, 8)], "id long, x double, y long")
    spec = MergeSpec.build(["x", "y"], [M("x", "firstMatch", ("a", "x"), ("b", "x")), M("y", "firstMatch", ("a", "y"), ("b", "y"))], logic="or")
    assert merge({"a": a, "b": b}, spec, ids={"a": "id", "b": "id"}).count() == 1


@pytest.mark.parametrize("ids,error", [([(1,), (1,)], "twice"), ([(1,), (None,)], "null")])
def test_bad_ids_are_refused(spark, ids, error):
    a = spark.createDataFrame([(*i, "p", "q") for i in ids], "id long, e1 string, e2 string")
    spec = MergeSpec.build(["e"], [M("e", "firstMatch", ("a", "e1"), ("a", "e2"))], logic="or")
    with pytest.raises(Exception, match=error):
        merge({"a": a}, spec, ids={"a": "id"}).collect()


def test_rows_merged_without_grouping_apply_their_policy(spark):
    a = spark.createDataFrame([(1, 10, 5)], "k long, x long, y long")
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("a", "k")), M("s", "sum", ("a", "x"), ("a", "y")), M("m", "min", ("a", "x"), ("a", "y"))])
    assert tuple(merge({"a": a}, spec, dedupe=False).first()) == (1, 15, 5)
    listed = MergeSpec.build(["k"], [M("k", "firstMatch", ("a", "k")), M("c", "concat", ("a", "x"))])
    with pytest.raises(SpecError, match="grouped"):
        merge({"a": a}, listed, dedupe=False)


# ---------------------------------------------------------------- entities
def test_row_policies_see_their_own_source(spark):
    a = spark.createDataFrame([(1, "e", 2, 3)], "id long, k string, x long, y long")
    b = spark.createDataFrame([(1, "e", "p"), (2, "e", None)], "id long, k string, v string")
    maps = [M("rs", "row_sum", ("a", "x"), ("a", "y")), M("fr", "first_row", ("b", "v")), M("vs", "values", ("b", "v"))]
    r = entity_merge({"a": a, "b": b}, [Link("a", "k", "b", "k")], maps, ids={"a": "id", "b": "id"}).first()
    assert (r.rs, r.fr, r.vs) == (5, "p", ["p", None])
    with pytest.raises(SpecError, match="one source"):
        entity_merge({"a": a, "b": b}, [Link("a", "k", "b", "k")], [M("rs", "row_sum", ("a", "x"), ("b", "id"))], ids={"a": "id", "b": "id"})


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [50, 60, 75, 85])
def test_fuzzy_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(threshold)
    vals = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(120)}
    df = spark.createDataFrame([("x", v) for v in vals] + [(None, "abc"), (None, "abd")], "block string, value string")
    got = {(r.a, r.b) for r in similar_values(df, None, threshold).collect()}
    assert got == {(a, b) for a in vals for b in vals if a < b and 100 * distance(a, b) <= (100 - threshold) * max(len(a), len(b))}


def test_fuzzy_candidates_are_few(spark):
    rng = random.Random(1)
    vals = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(21)) for _ in range(1000)}
    df = spark.createDataFrame([("", v) for v in vals], "block string, value string")
    pairs = len(vals) * (len(vals) - 1) / 2
    assert _candidates(df, df, 85).count() < 0.01 * pairs
    assert _candidates(df, df, 60).count() < 0.15 * pairs


def test_hot_value_joins_are_split(spark):
    """A value that most rows hold: the join to the value's anchor splits it over several tasks."""
    n = 200_000
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 5 < 3, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") / 10).cast("long").cast("string")))
        df = spark.range(0, n, 1, 8).select("id", key.alias("key"))
        edges = _value_star_edges(df.select(F.col("id").alias(ROW_ID), "key", F.lit(2).alias("side")), False)
        edges.write.format("noop").mode("overwrite").save()
        rows = edges.collect()
        assert len(rows) == n - df.select("key").distinct().count()
        assert "skew=true" in plan_text(edges)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---------------------------------------------------------------- sources, plans, reports
def test_csv_quotes_and_line_breaks(spark, tmpdir_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, " blanks "), (4, None)]
    out = os.path.join(tmpdir_path, "out")
    write(spark.createDataFrame(rows, "k long, v string"), out, "csv")
    back = read_csv(spark, out + "/*.csv", multi_line=True)
    assert sorted((r.k, r.v) for r in back.collect()) == rows
    with pytest.raises(SpecError):
        load_source(spark, f"a:{tmpdir_path}/none.csv")


def test_blob_source_reads_its_own_bytes(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "other.csv"), "w") as f:
        f.write("id,v\n9,z\n")
    plan = {"sources": [{"Blob": {"id": "b", "data": list(b'id,v\n1,"x, y"\n2,\n'), "format": "csv"}}],
            "query": {"type": "dsl", "destination_schema": [{"name": "id"}, {"name": "v"}], "primary_keys": {"keys": ["id"]},
                      "mappings": [{"destination_field": d, "source_fields": [{"source_file_id": "b", "column_name": d}]} for d in ("id", "v")]}}
    assert sorted(map(tuple, run_plan(spark, plan, base_dir=tmpdir_path).collect())) == [(1, "x, y"), (2, None)]


def test_named_function_in_a_plan(spark):
    register_function("spread", lambda c: F.max(c) - F.min(c))
    spec = MergeSpec.from_dict({"primary_keys": {"keys": ["k"]}, "destination_schema": [{"name": "k"}, {"name": "d"}, {"name": "m"}], "mappings": [
        {"destination_field": "k", "source_fields": [{"source_file_id": "a", "column_name": "k"}]},
        {"destination_field": "d", "policy": {"type": "custom", "function": "spread"}, "source_fields": [{"source_file_id": "a", "column_name": "x"}]},
        {"destination_field": "m", "policy": {"type": "custom", "function": "median"}, "source_fields": [{"source_file_id": "a", "column_name": "x"}]}]})
    a = spark.createDataFrame([(1, 2), (1, 9), (1, 4)], "k long, x long")
    assert tuple(merge({"a": a}, spec).first()) == (1, 7, 4.0)


def test_predicate_trees(spark):
    tree = {"And": {"left": {"GreaterThan": {"column": "x", "value": "1"}}, "right": {"Not": {"predicate": {"Equals": {"column": "x", "value": "3"}}}}}}
    assert [r.x for r in filter_rows(spark.range(5).toDF("x"), from_dict(tree)).orderBy("x").collect()] == [2, 4]


def test_sql_leaves_own_views(spark):
    spark.range(3).createOrReplaceTempView("mine")
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    assert sql({"mine": df, "my-file": df}, "SELECT count(*) AS n FROM mine JOIN `my-file` USING (k)").first().n == 1
    assert spark.table("mine").count() == 3
    spark.catalog.dropTempView("mine")


def test_date_under_a_numeric_policy_is_reported(spark):
    a = spark.createDataFrame([(1, "2024-01-01")], "k long, d string").withColumn("d", F.to_date("d"))
    spec = MergeSpec.build(["k"], [M("k", "firstMatch", ("a", "k")), M("s", "sum", ("a", "d"))])
    assert [(r.field, r.reason) for r in unresolved({"a": a}, spec).collect()] == [("a.d", "type mismatch")]
