"""Ordered lists in chunks (P9-P11) and pages by a stored index."""

import random

import pytest
from pyspark.sql import functions as F

from keymerge import chunked_values, places, read_page, write_pages
from keymerge.plans.explain import plan_report, plan_text
from keymerge.spec import SpecError


@pytest.mark.parametrize("partitions", [1, 5, 16])
def test_chunks_laid_together_are_the_list(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(50)]), k, rng.choice([None, "x", "y"])) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, o int, id int, v string").repartition(3)
    got = chunked_values(df, ["k"], "v", ["o", "id"], chunk=7, partitions=partitions).collect()
    lists, sizes = {}, {}
    for r in sorted(got, key=lambda r: r.chunk):
        assert len(r["values"]) == r.n <= 7
        lists.setdefault(r.k, []).extend(r["values"])
        sizes.setdefault(r.k, []).append(r.chunk)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert lists == {k: [r[3] for r in order if r[0] == k] for k in (1, 2, None)}
    assert all(c == list(range(len(c))) for c in sizes.values())


def test_a_hot_key_spans_many_tasks(spark):
    df = spark.range(20_000).selectExpr("7 AS k", "id")
    placed = places(df, ["k"], ["id"], partitions=10)
    assert placed.filter("_place <> id").count() == 0
    out = chunked_values(df, ["k"], "id", ["id"], chunk=500, partitions=10)
    assert out.agg(F.max("n"), F.count("*")).first()[:] == (500, 40)
    assert plan_report(out)["python_arrow_ops"] == 0


def test_nulls_empty_and_errors(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, None)], "k int, v int")
    assert {(r.k, tuple(r["values"])) for r in chunked_values(df, ["k"], "v", ["v"], skip_nulls=True).collect()} == {(1, (5,))}
    assert {(r.k, tuple(r["values"])) for r in chunked_values(df, ["k"], "v", [F.desc("v")]).collect()} == {(1, (5, None)), (2, (None,))}
    assert chunked_values(df.limit(0), ["k"], "v", ["v"]).count() == 0
    with pytest.raises(SpecError):
        chunked_values(df, ["k"], "v", ["v"], chunk=0)


def test_pages(spark, tmpdir_path):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 20)) for k in range(1000)]
    index = write_pages(spark.createDataFrame(rows, "id int, s int").repartition(7), f"{tmpdir_path}/p", [F.desc("s"), "id"], partitions=8)
    assert index.agg(F.sum("n")).first()[0] == 1000 and index.count() > 4
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for page, size in ((0, 30), (7, 30), (33, 30), (34, 30), (1, 600), (99, 10)):
        got = read_page(spark, f"{tmpdir_path}/p", page, size).orderBy("_row").collect()
        assert [(r.id, r.s) for r in got] == order[page * size : (page + 1) * size]
        assert [r["_row"] for r in got] == list(range(page * size, min(1000, (page + 1) * size)))
    assert len(read_page(spark, f"{tmpdir_path}/p", 3, 20).select(F.input_file_name()).distinct().collect()) <= 2
    text = plan_text(read_page(spark, f"{tmpdir_path}/p", 3, 20))
    assert "PartitionFilters: [isnotnull(part" in text or "PartitionFilters: [part" in text
    with pytest.raises(SpecError):
        read_page(spark, f"{tmpdir_path}/p", -1, 10)
