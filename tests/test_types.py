"""Type inference on the reference's inline CSVs, semantic profile, ranges."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from keymerge import read_csv
from keymerge.operators.types import cast_declared, infer_column_types, profile, split_by_type, type_ranges


def csv(spark, text):
    d = tempfile.mkdtemp(prefix="km-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as fh:
        fh.write(text)
    return read_csv(spark, p)


CASES = {
    "basic": ("id,name,age,email,active\n1,Alice,25,alice@example.com,true\n2,Bob,30,bob@example.com,false\n"
              "3,Charlie,28,charlie@example.com,true",
              [("id", "bigint"), ("name", "string"), ("age", "bigint"), ("email", "string"), ("active", "boolean")]),
    "mixed": ("id,contact_info,amount\n1,alice@example.com,100.50\n2,+1-555-0123,200\n3,bob@company.org,300.75\n"
              "4,555-0199,invalid\n5,charlie@test.com,450",
              [("id", "bigint"), ("contact_info", "string"), ("amount", "string")]),
    "dates": ("id,created_at,birthday,timestamp\n1,2023-01-15,1990-05-20,2023-01-15T10:30:00Z\n"
              "2,2023-02-20,1985-12-03,2023-02-20T14:45:30Z\n3,2023-03-10,1992-07-18,2023-03-10T09:15:45Z",
              [("id", "bigint"), ("created_at", "string"), ("birthday", "string"), ("timestamp", "string")]),
    "numeric": ("id,small_int,big_int,decimal,percentage\n1,5,1000000,123.456,0.85\n2,10,2000000,789.012,0.92\n"
                "3,-3,3000000,-456.789,1.05",
                [("id", "bigint"), ("small_int", "bigint"), ("big_int", "bigint"), ("decimal", "double"),
                 ("percentage", "double")]),
    "nulls": ("id,optional_email,optional_number,mixed_nulls\n1,alice@example.com,100,value1\n2,,200,\n"
              "3,bob@example.com,,value3\n4,,,\n5,charlie@example.com,300,value5",
              [("id", "bigint"), ("optional_email", "string"), ("optional_number", "bigint"), ("mixed_nulls", "string")]),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_csv_inference(spark, case):
    text, expected = CASES[case]
    assert csv(spark, text).dtypes == expected


def test_partial_scan(spark):
    text = "id,category,value\n" + "".join(f"{i},product,{i * 10}.99\n" for i in range(1, 10101))
    df = csv(spark, text)
    assert df.dtypes == [("id", "bigint"), ("category", "string"), ("value", "double")]
    assert df.count() == 10100
    raw = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    assert infer_column_types(raw, sample=100) == {"id": "bigint", "category": "string", "value": "double"}


def test_sample_can_miss_late_bad_token(spark):
    raw = spark.createDataFrame([(str(i),) for i in range(200)] + [("oops",)], "v string").coalesce(1)
    assert infer_column_types(raw, sample=100) == {"v": "bigint"}
    assert infer_column_types(raw) == {"v": "string"}


def test_semantic_profile_and_split(spark):
    df = spark.createDataFrame([(1, "alice@example.com"), (2, "bob@example.com"), (3, "555-0123"), (4, "555-0199"),
                                (5, "charlie@example.com"), (6, "not_email_or_phone"), (7, "+1-555-0187"),
                                (8, None)], "id long, value string")
    prof = {(r["semantic_type"]): (r["n"], r["is_mixed"]) for r in profile(df, ["value"]).collect()}
    assert prof == {"email": (3, True), "phone": (3, True), "text": (1, True)}
    split = split_by_type(df, "value").orderBy("id").collect()
    assert split[0]["value__email"] == "alice@example.com" and split[0]["value__phone"] is None
    assert split[2]["value__phone"] == "555-0123"


def test_type_ranges_fixture(spark):
    df = spark.createDataFrame([(1, "alice@example.com"), (2, "bob@example.com"), (3, "555-0123"), (4, "555-0199"),
                                (5, "charlie@example.com"), (6, "not_email_or_phone"), (7, "+1-555-0187")],
                               "id long, value string")
    got = [(r["start_row"], r["end_row"], r["semantic_type"]) for r in
           type_ranges(df, "value", "id", partitions=3).orderBy("start_row").collect()]
    assert got == [(1, 2, "email"), (3, 4, "phone"), (5, 5, "email"), (6, 6, "text"), (7, 7, "phone")]


def test_type_ranges_stitch_across_partitions(spark):
    import random

    rnd = random.Random(5)
    vals = [rnd.choice(["a@b.co", "12", "x y"]) for _ in range(500)]
    vals[100:260] = ["12"] * 160  # one run spanning several range partitions
    df = spark.createDataFrame(list(enumerate(vals)), "id long, v string")
    got = [(r["start_row"], r["end_row"]) for r in type_ranges(df, "v", "id", partitions=7).orderBy("start_row").collect()]
    expected, start = [], 0
    for i in range(1, len(vals) + 1):
        if i == len(vals) or vals[i] != vals[start]:
            expected.append((start + 1, i))
            start = i
    assert got == expected


def test_declared_cast_flags_mismatch(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,)], "v string")
    out = cast_declared(df, {"v": "Float64"}).collect()
    assert [(r["v__cast"], r["v__mismatch"]) for r in out] == [(1.5, False), (None, True), (None, False)]


def test_schema_hint_overrides_inference(spark):
    from keymerge.operators.types import apply_types

    raw = spark.createDataFrame([("1", "2.5", "true"), ("2", "3", "false")], "a string, b string, c string")
    out = apply_types(raw, schema_hint={"a": "string", "b": "double"})
    assert out.dtypes == [("a", "string"), ("b", "double"), ("c", "boolean")]


def test_profile_unknown_for_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, empty string")
    rows = {(r["column"], r["semantic_type"]): r for r in profile(df, ["id", "empty"]).collect()}
    assert rows[("empty", "unknown")]["n"] == 0
    assert rows[("id", "integer")]["n"] == 2 and rows[("id", "integer")]["is_mixed"] is False


def test_local_runs_carry_across_batches():
    import random

    import pandas as pd

    from keymerge.operators.types import _local_runs

    rnd = random.Random(1)
    vals = [rnd.choice(["a", "b", None]) for _ in range(60)] + ["a"] * 25 + [None] * 7
    cuts = [0, 5, 6, 30, 55, 80, 81, len(vals)]
    batches = [pd.DataFrame({"_pid": [3] * (b - a), "_t": vals[a:b]}) for a, b in zip(cuts, cuts[1:])]
    got = [(r["_seq"], r["_start"], r["_len"], r["semantic_type"]) for df in _local_runs(iter(batches))
           for r in df.to_dict("records")]
    want, start = [], 0
    for i in range(1, len(vals) + 1):
        if i == len(vals) or vals[i] != vals[start]:
            want.append((len(want), start, i - start, vals[start]))
            start = i
    assert got == want


def test_parse_dates_opt_in(spark):
    text = ("id,created_at,birthday,timestamp\n1,2023-01-15,1990-05-20,2023-01-15T10:30:00Z\n"
            "2,2023-02-20,1985-12-03,2023-02-20T14:45:30Z\n")
    d = tempfile.mkdtemp(prefix="km-dates-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as fh:
        fh.write(text)
    df = read_csv(spark, p, parse_dates=True)
    assert df.dtypes == [("id", "bigint"), ("created_at", "date"), ("birthday", "date"), ("timestamp", "timestamp")]
    r = df.orderBy("id").first()
    assert str(r["created_at"]) == "2023-01-15"


def test_profile_zip_codes_follow_the_column(spark):
    df = spark.createDataFrame([("SW1A 1AA", "10001"), ("K1A 0B1", "20002"), ("10001", "30003")],
                               "postal_code string, plain string")
    got = {(r["column"], r["semantic_type"]): r["n"] for r in profile(df).collect()}
    assert got == {("postal_code", "postcode"): 3, ("plain", "integer"): 3}
