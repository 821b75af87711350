"""Delimited text with line breaks inside quotes, read in parallel."""

import os
import random

import pytest
from pyspark.sql import functions as F

from keymerge.operators.types import apply_types
from keymerge.sources import payload_csv, read_csv
from keymerge.sources.records import Quotes, read_records


def fields(rng, n):
    out = []
    for _ in range(n):
        kind = rng.random()
        text = "".join(rng.choice('ab ,\n"x;é') for _ in range(rng.randint(0, 9)))
        if kind < 0.2:
            out.append(str(rng.randint(0, 99)))
        elif kind < 0.3:
            out.append('in"ch')  # a quote within an unquoted field is text
        elif kind < 0.4:
            out.append("")
        else:
            out.append('"' + text.replace('"', '""') + '"')
    return ",".join(out)


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def write_file(folder, name, text):
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
        f.write(text)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_equal_the_unsplit_read(spark, small_splits, tmpdir_path, end):
    rng = random.Random(len(end))
    for k in range(3):
        rows = [fields(rng, 4) for _ in range(60)] + ["", '"very\nlong ' + "line\n" * 120 + '",b,c,d', "1,2,3,4"]
        rng.shuffle(rows)
        for name, e in (("plain", "\n"), ("read", end)):
            os.makedirs(f"{tmpdir_path}/{name}", exist_ok=True)
            write_file(f"{tmpdir_path}/{name}", f"f{k}.csv", e.join(['h1,"h\n2",h3,h4', *rows]) + (e if k else ""))
    want = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(f"{tmpdir_path}/plain")
    got = read_csv(spark, f"{tmpdir_path}/read", multi_line=True, infer=False)
    assert got.columns == want.columns == ["h1", "h\n2", "h3", "h4"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert read_records(spark, f"{tmpdir_path}/read").select("file", "block").distinct().count() > 30


def test_every_split_of_a_text_gives_the_same_records(spark, tmpdir_path):
    rng = random.Random(4)
    text = "\n".join(fields(rng, 3) for _ in range(40))
    write_file(tmpdir_path, "a.csv", text)
    want = Quotes().records(text)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in (3, 33, 500, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            rows = read_records(spark, tmpdir_path).orderBy("file", "block", "seq").collect()
            assert [r.record for r in rows] == want
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_records_of_a_text():
    q = Quotes()
    assert q.records('a,"b\nc",d\n\ne,f"g\r\n"h""\n"",i\n"open\nend') == ['a,"b\nc",d', 'e,f"g', '"h""\n"",i\n"open', "end"]
    assert q.records('a,"open\nend') == ['a,"open\nend']
    assert q.records('"a"b\nc,"x"\n') == ['"a"b', 'c,"x"']
    assert q.records("") == [] and Quotes("\t").records('a\t"b\n"\nc,"d') == ['a\t"b\n"', 'c,"d']
    with pytest.raises(ValueError):
        Quotes("||")


def test_unclosed_quote_and_header_over_splits(spark, small_splits, tmpdir_path):
    write_file(tmpdir_path, "a.csv", '\n\n"first\n' + "x\n" * 100 + '",second\n1,2\n3,"open\n4,5')
    rows = read_csv(spark, tmpdir_path, multi_line=True, infer=False).collect()
    assert sorted(map(tuple, rows)) == [("1", "2"), ("3", "open\n4,5")]


def test_types_are_found_over_splits(spark, small_splits, tmpdir_path):
    write_file(tmpdir_path, "a.csv", "id,said,n\n" + "\n".join(f'{k},"say\n""{k}""",{k}.5' for k in range(200)))
    df = read_csv(spark, tmpdir_path, multi_line=True)
    assert dict(df.dtypes) == {"id": "bigint", "said": "string", "n": "double"}
    assert {(r.id, r.said, r.n) for r in df.collect()} == {(k, f'say\n"{k}"', k + 0.5) for k in range(200)}


def test_payloads_with_quoted_breaks(spark):
    df = spark.createDataFrame([(1, 'a,b,c\n1,"x ""y"", z",2\n3,"two\nlines",4\r\n'), (2, "a,b,c"), (3, None), (4, "a,b,c\n5,,")], "id int, payload string")
    rows = payload_csv(df, "payload", "a int, b string, c int", keep=["id"]).collect()
    assert sorted((r.id, r["_line_no"], r.a, r.b, r.c) for r in rows) == [(1, 1, 1, 'x "y", z', 2), (1, 2, 3, "two\nlines", 4), (4, 1, 5, None, None)]


def test_many_payloads_are_split_a_few_at_a_time():
    """A batch of many payloads is taken in parts of bounded text, in order, none left out."""
    import pyarrow as pa

    from keymerge.sources.records import TEXT_BYTES, _text_parts

    texts = ["x" * n for n in (0, TEXT_BYTES // 2, TEXT_BYTES // 2, 1, 3 * TEXT_BYTES, 5, TEXT_BYTES)] + [None, ""] * 3
    parts = list(_text_parts(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "t"]), 1))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert [t for p in parts for t in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= TEXT_BYTES for p in parts) and len(parts) == 5
    assert list(_text_parts(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["t"]), 0)) == []


def test_payload_text_is_not_repeated_for_its_records(spark):
    from keymerge.sources.records import explode_records

    df = spark.createDataFrame([(1, "a\nb", "x"), (2, None, "y"), (3, 'c,"d\ne"', "z")], "id int, payload string, more string")
    lines = explode_records(df, "payload")
    assert lines.columns == ["id", "more", "_line_no", "_line"]
    assert sorted(map(tuple, lines.collect())) == [(1, "x", 0, "a"), (1, "x", 1, "b"), (3, "z", 0, 'c,"d\ne"')]
