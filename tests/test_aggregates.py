"""Custom aggregates with partial states."""

import random
from collections import Counter, defaultdict

import pytest

from keymerge import plan_report
from keymerge.operators import aggregates
from keymerge.operators.aggregates import Aggregate, aggregate_by, fanned_aggregate
from keymerge.spec import SpecError

# The three commonest values, then by value; and a geometric mean.
TOP = Aggregate(Counter, lambda s, v: s.update([v]) or s, lambda a, b: a.update(b) or a,
                lambda s: ",".join(f"{v}:{n}" for v, n in sorted(s.items(), key=lambda x: (-x[1], str(x[0])))[:3]), "string")
SPAN = Aggregate(lambda: (None, None, 0), lambda s, a, b: (min(a, s[0]) if s[2] else a, max(b, s[1]) if s[2] else b, s[2] + 1),
                 lambda x, y: x if not y[2] else y if not x[2] else (min(x[0], y[0]), max(x[1], y[1]), x[2] + y[2]), lambda s: s[1] - s[0], "long")


def data(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice("abcde"), rng.randint(0, 100)) for _ in range(500)]
    return rows, spark.createDataFrame(rows, "k int, v string, n long").repartition(6)


@pytest.mark.parametrize("held", [1, 100_000])
def test_equals_python(spark, monkeypatch, held):
    monkeypatch.setattr(aggregates, "HELD_STATES", held)
    rows, df = data(spark)
    groups = defaultdict(Counter)
    for k, v, _ in rows:
        groups[k][v] += 1
    got = aggregate_by(df, ["k"], ["v"], TOP, "top")
    assert {r.k: r.top for r in got.collect()} == {k: TOP.finish(c) for k, c in groups.items()}
    report = plan_report(got)
    assert report["sort_merge_joins"] == 0 and report["shuffles"] <= 2  # the test's own and one of states
    spans = {r.k: r.span for r in aggregate_by(df, ["k"], ["n", "n"], SPAN, "span").collect()}
    assert spans == {k: max(n for x, _, n in rows if x == k) - min(n for x, _, n in rows if x == k) for k in groups}


def test_fan_out_without_the_join(spark):
    rows, df = data(spark)
    rng = random.Random(4)
    other = [(rng.choice([1, 2, 2, 4, None]),) for _ in range(40)]
    third = [(rng.choice([1, 1, 2, 3]),) for _ in range(9)]
    got = fanned_aggregate({"a": df, "b": spark.createDataFrame(other, "x int"), "c": spark.createDataFrame(third, "y int")},
                           {"a": ["k"], "b": ["x"], "c": ["y"]}, "a", ["v"], TOP, "top")
    joined = defaultdict(Counter)
    for k, v, _ in rows:
        for (x,) in other:
            for (y,) in third:
                if k is not None and k == x == y:
                    joined[k][v] += 1
    assert {r.k: r.top for r in got.collect()} == {k: TOP.finish(c) for k, c in joined.items()}


def test_doubling():
    for n in (0, 1, 2, 3, 7, 1000):
        assert TOP.times(Counter("aab"), n) == Counter({k: v * n for k, v in Counter("aab").items() if n})


def test_empty_and_errors(spark):
    _, df = data(spark)
    assert aggregate_by(df.limit(0), ["k"], ["v"], TOP, "top").count() == 0
    with pytest.raises(SpecError):
        aggregate_by(df.withColumnRenamed("k", "n2").withColumnRenamed("n", "state"), ["state"], ["v"], TOP, "top")
