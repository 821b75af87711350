"""As-of, interval and range joins (J11) against brute force."""

import datetime as dt
import random

import pytest

from keymerge.operators.timejoins import asof_join, interval_join, range_join
from keymerge.plans.explain import plan_report
from keymerge.spec import SpecError


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def brute_asof(left, right, forward=False, exact=True, tolerance=None, inner=False):
    out = []
    for i, k, t in left:
        best = None
        for k2, t2, v in right:
            if None in (k, k2, t, t2) or k != k2 or (t2 > t if not forward else t2 < t) or (t2 == t and not exact):
                continue
            if tolerance is not None and abs(t - t2) > tolerance:
                continue
            rank = (-t2, -v) if forward else (t2, v)
            if best is None or rank > best[0]:
                best = rank, t2, v
        if best or not inner:
            out.append((i, k, t, best[1] if best else None, best[2] if best else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(60)])) for i in range(200)]
    right = [(rng.choice([1, 1, 1, 2, 4, None]), rng.choice([None, *range(60)]), v) for v in range(120)]
    return left, right, spark.createDataFrame(left, "id int, k int, t long").repartition(3), spark.createDataFrame(right, "k int, rt long, v int").repartition(3)


@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
@pytest.mark.parametrize("kw", [{}, {"forward": True}, {"exact": False}, {"tolerance": 2}, {"inner": True, "forward": True, "exact": False}])
def test_asof(sides, rows_per_task, kw):
    left, right, ldf, rdf = sides
    got = asof_join(ldf, rdf, "k", "t", "rt", how="inner" if kw.get("inner") else "left", direction="forward" if kw.get("forward") else "backward",
                    allow_exact=kw.get("exact", True), tie_by="v", tolerance=kw.get("tolerance"), rows_per_task=rows_per_task)
    assert got.columns == ["id", "k", "t", "rt", "v"]
    assert rows(got) == brute_asof(left, right, **kw)


def test_asof_hot_key_is_spread(spark):
    """One key holds all rows: with chunks of 500 rows no window of more than a few hundred is sorted, and the result is right."""
    left = spark.range(3000).selectExpr("id", "7 AS k", "id * 2 AS t")
    right = spark.range(2000).selectExpr("7 AS k", "id * 3 AS rt", "id AS v")
    got = {r.id: r.v for r in asof_join(left, right, "k", "t", "rt", rows_per_task=500).collect()}
    assert got == {i: min(i * 2 // 3, 1999) for i in range(3000)}


@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval(spark, kind, how):
    rng = random.Random(len(kind))
    make = {"long": lambda x: x, "double": lambda x: x / 7, "date": lambda x: dt.date(2000, 1, 1) + dt.timedelta(days=x),
            "timestamp": lambda x: dt.datetime(2000, 3, 26, 0, 30) + dt.timedelta(minutes=x), "timestamp_ntz": lambda x: dt.datetime(2000, 3, 26, 0, 30) + dt.timedelta(minutes=x)}[kind]
    points = [(i, rng.choice([1, 1, 2, None]), None if rng.random() < 0.1 else make(rng.randint(-50, 300))) for i in range(120)]
    spans = []
    for v in range(80):
        s = rng.randint(-60, 300)
        spans.append((rng.choice([1, 1, 2, 3, None]), None if rng.random() < 0.1 else make(s), make(s + rng.choice([-1, 0, 0, 1, 5, 40, 300])), v))
    p = spark.createDataFrame(points, f"id int, k int, t {kind}").repartition(3)
    s = spark.createDataFrame(spans, f"k int, a {kind}, b {kind}, v int").repartition(3)
    want = []
    for i, k, t in points:
        held = [(a, b, v) for k2, a, b, v in spans if None not in (k, k2, t, a) and k == k2 and a <= t <= b]
        want += [(i, k, t, *h) for h in held] or ([(i, k, t, None, None, None)] if how == "left" else [])
    got = interval_join(p, s, "k", "t", "a", "b", how=how)
    assert rows(got) == sorted(map(repr, want))
    report = plan_report(got)
    assert report["nested_loop_joins"] == 0


def test_range(spark):
    rng = random.Random(3)
    left = [(i, rng.randint(0, 2), rng.uniform(-5, 5)) for i in range(80)]
    right = [(rng.randint(0, 2), rng.uniform(-5, 5), v) for v in range(80)]
    got = range_join(spark.createDataFrame(left, "id int, k int, x double"), spark.createDataFrame(right, "k int, y double, v int"), "k", "x", "y", 0.25)
    want = [(i, k, x, y, v) for i, k, x in left for k2, y, v in right if k == k2 and y - 0.25 <= x <= y + 0.25]
    assert rows(got) == sorted(map(repr, want)) and got.columns == ["id", "k", "x", "y", "v"]


def test_empty_sides_and_errors(spark):
    e = spark.createDataFrame([], "k int, rt long, v int")
    p = spark.createDataFrame([(1, 1, 5)], "id int, k int, t long")
    assert rows(asof_join(p, e, "k", "t", "rt")) == ["(1, 1, 5, None, None)"]
    assert interval_join(p, e.withColumnRenamed("v", "w"), "k", "t", "rt", "rt").count() == 0
    with pytest.raises(SpecError):
        asof_join(p, e.withColumnRenamed("v", "t"), "k", "t", "rt")
    with pytest.raises(SpecError):
        asof_join(p, e, [], "t", "rt")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_pairs_of_a_hot_bin_are_spread(spark, how):
    """All rows lie within reach of each other, many alike: with 400 pairs a task none has more than a part of them."""
    left = spark.createDataFrame([(1, 0.5)] * 60 + [(1, 1.0), (2, 1.0), (1, None), (None, 1.0), (3, 9.0)], "k int, x double")
    right = spark.createDataFrame([(1, 0.5)] * 50 + [(1, 0.75), (2, 1.25), (1, None), (None, 1.0), (4, 1.0)], "k int, y double")
    got = range_join(left, right, "k", "x", "y", 0.5, how=how, pairs_per_task=400)
    want = [(k, x, y) for k, x in map(tuple, left.collect()) for k2, y in map(tuple, right.collect())
            if None not in (k, x, y) and k == k2 and y - 0.5 <= x <= y + 0.5]
    alone = [(1, None, None), (None, 1.0, None), (3, 9.0, None)] if how == "left" else []
    assert rows(got) == sorted(map(repr, want + alone)) and len(want) == 61 * 51 + 1
    tasks = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(tasks) <= len(want) // 3
