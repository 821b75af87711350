"""Incremental merge by states (I1): signed changes against a full merge; no scan of sources."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keymerge import Mapping, MergeSpec, Policy, SourceField, merge
from keymerge.operators.states import SIGN, apply_changes, finish_states, merge_states
from keymerge.plans.explain import plan_text
from keymerge.spec import SpecError

ORDER = {"a": "id", "b": "bid"}
DDL = {"a": "id long, k int, v decimal(9,2), s string", "b": "bid long, key int, w long, t string"}


def spec():
    f = SourceField
    return MergeSpec.build(["k"], [
        Mapping("k", Policy("firstMatch"), (f("a", "k"), f("b", "key"))),
        Mapping("total", Policy("sum"), (f("a", "v"), f("b", "w"))),
        Mapping("mean", Policy("average"), (f("a", "v"),)),
        Mapping("n", Policy("count"), (f("b", "t"),)),
        Mapping("rows", Policy("count_rows"), (f("a", "id"),)),
        Mapping("low", Policy("min"), (f("a", "v"),)),
        Mapping("high", Policy("max"), (f("b", "w"),)),
        Mapping("first", Policy("firstMatch", ("b",)), (f("a", "s"), f("b", "t"))),
        Mapping("last", Policy("lastMatch"), (f("a", "s"),)),
        Mapping("top", Policy("first_row"), (f("b", "t"),)),
    ])


def row_a(rng):
    return rng.choice([1, 1, 2, 3, 4, 5, None]), rng.choice([None, Decimal(rng.randint(-500, 500)) / 100]), rng.choice([None, "x", "y", "z"])


def row_b(rng):
    return rng.choice([1, 2, 2, 3, 6, None]), rng.choice([None, rng.randint(-9, 9)]), rng.choice([None, "p", "q"])


def frame(spark, name, rows, sign=None):
    df = spark.createDataFrame([(i, *r) for i, r in rows], DDL[name])
    return df if sign is None else df.withColumn(SIGN, F.lit(sign))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("how,fanout", [("inner", "rows"), ("left", "safe"), ("full", "rows")])
def test_equals_a_full_merge_after_changes(spark, how, fanout):
    rng = random.Random(len(how))
    make = {"a": row_a, "b": row_b}
    data = {"a": {i: row_a(rng) for i in range(40)}, "b": {i: row_b(rng) for i in range(30)}}
    sources = {s: frame(spark, s, d.items()) for s, d in data.items()}
    kw = {"how": how, "fanout": fanout, "order_by": ORDER}
    result, states = merge(sources, spec(), **kw), merge_states(sources, spec(), ORDER)
    assert rows(finish_states(states, sources, spec(), **kw)) == rows(result)
    for step in range(2):
        changes = {}
        for s in ("a", "b") if step else ("a",):
            d, gone, came = data[s], [], []
            for i in rng.sample(sorted(d), 8):
                gone.append((i, d.pop(i)))
                if rng.random() < 0.5:
                    d[i] = make[s](rng)
                    came.append((i, d[i]))
            for i in range(100 * step + 100, 100 * step + 104):
                d[i] = make[s](rng)
                came.append((i, d[i]))
            changes[s] = frame(spark, s, gone, -1).unionByName(frame(spark, s, came, 1))
        result, states = apply_changes(result, states, sources, spec(), changes, **kw)
        new = {s: frame(spark, s, d.items()) for s, d in data.items()}
        assert rows(result) == rows(merge(new, spec(), **kw)), step


def test_unchanged_sources_are_not_scanned(spark, tmpdir_path):
    rng = random.Random(1)
    for s, make in (("a", row_a), ("b", row_b)):
        frame(spark, s, [(i, make(rng)) for i in range(30)]).write.parquet(f"{tmpdir_path}/{s}")
    sources = {s: spark.read.parquet(f"{tmpdir_path}/{s}") for s in DDL}
    states = {}
    for name, df in merge_states(sources, spec(), ORDER).items():
        df.write.parquet(f"{tmpdir_path}/state/{name}")
        states[name] = spark.read.parquet(f"{tmpdir_path}/state/{name}")
    result = spark.createDataFrame(merge(sources, spec(), order_by=ORDER).collect(), merge(sources, spec(), order_by=ORDER).schema)
    change = frame(spark, "a", [(99, (2, Decimal("1.00"), "new"))], 1)
    got, _ = apply_changes(result, states, sources, spec(), {"a": change}, order_by=ORDER)
    assert f"{tmpdir_path}/a" not in plan_text(got) and f"{tmpdir_path}/b" not in plan_text(got)
    full = merge({**sources, "a": sources["a"].unionByName(change.drop(SIGN))}, spec(), order_by=ORDER)
    assert rows(got) == rows(full)


def test_refusals(spark):
    f = SourceField
    src = {"a": spark.createDataFrame([], "id long, k int, v double")}
    def one(kind):
        return MergeSpec.build(["k"], [Mapping("k", Policy("firstMatch"), (f("a", "k"),)), Mapping("x", Policy(kind), (f("a", "v"),))])
    for kind in ("sum", "values", "firstMatch"):
        with pytest.raises(SpecError):
            merge_states(src, one(kind))
    assert finish_states(merge_states(src, one("max")), src, one("max")).count() == 0
