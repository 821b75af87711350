"""I1 for OR keys: inserts, updates and deletes against a full merge."""

import random

import pytest
from pyspark.sql import functions as F

from keymerge import Mapping, MergeSpec, Policy, SourceField, merge
from keymerge.operators.incremental import changed_ids, or_state, remerge_or
from keymerge.spec import SpecError

IDS = {"a": "id", "b": "bid"}
ORDER = {"a": "id", "b": "bid"}


def spec():
    f = SourceField
    return MergeSpec.build(["email", "phone"], [
        Mapping("email", Policy("firstMatch"), (f("a", "email"), f("b", "mail"))),
        Mapping("phone", Policy("firstMatch"), (f("a", "phone"),)),
        Mapping("total", Policy("sum"), (f("a", "v"), f("b", "w"))),
        Mapping("names", Policy("values"), (f("a", "name"),)),
        Mapping("last", Policy("lastMatch"), (f("b", "w"),)),
    ], logic="or")


def frames(spark, a, b):
    return {"a": spark.createDataFrame([(i, *r) for i, r in a.items()], "id long, email string, phone string, v long, name string"),
            "b": spark.createDataFrame([(i, *r) for i, r in b.items()], "bid long, mail string, w long")}


def row_a(rng):
    return rng.choice([None, "", *[f"e{k}" for k in range(25)]]), rng.choice([None, *[f"e{k}" for k in range(25)]]), rng.randint(0, 9), rng.choice("xyz")


def row_b(rng):
    return rng.choice([None, *[f"e{k}" for k in range(30)]]), rng.choice([None, 1, 2, 3])


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def state_rows(df):
    return sorted((r["_row_id"], r["entity_id"], sorted((k.ki, k.key) for k in r["keys"])) for r in df.collect())


def test_equals_a_full_merge_after_each_change(spark):
    rng = random.Random(2)
    a, b = {i: row_a(rng) for i in range(40)}, {i: row_b(rng) for i in range(25)}
    src = frames(spark, a, b)
    result, state = merge(src, spec(), ids=IDS, order_by=ORDER), or_state(src, spec(), IDS)
    for step in range(3):
        old = {"a": dict(a), "b": dict(b)}
        if step != 1:
            for i in rng.sample(sorted(a), 3):
                del a[i]  # deletes
        if step != 2:
            for i in rng.sample(sorted(a), 3):
                a[i] = row_a(rng)  # updates
            b[rng.choice(sorted(b))] = row_b(rng)
        for k in range(3):
            a[100 + 10 * step + k] = row_a(rng)  # inserts
        b.pop(rng.choice(sorted(b)))
        new = frames(spark, a, b)
        changes = {s: changed_ids(frames(spark, old["a"], old["b"])[s], new[s], IDS[s]) for s in IDS}
        result, state = remerge_or(result, state, new, spec(), changes, IDS, ORDER)
        result, state = result.cache(), state.cache()
        assert rows(result) == rows(merge(new, spec(), ids=IDS, order_by=ORDER)), step
        assert state_rows(state) == state_rows(or_state(new, spec(), IDS)), step


def test_joining_split_and_untouched_entities(spark):
    a = {1: ("e1", "p1", 1, "x"), 2: ("e2", "p1", 1, "x"), 3: ("e3", "p3", 1, "x"), 4: ("e4", "p3", 1, "x"), 7: ("e7", "p7", 1, "x")}
    src = frames(spark, a, {})
    result, state = merge(src, spec(), ids=IDS, order_by=ORDER), or_state(src, spec(), IDS)
    a = {1: ("e1", "p1", 1, "x"), 2: ("e2", "p2", 1, "x"), 3: ("e3", "p3", 1, "x"), 4: ("e4", "p3", 1, "x"), 7: ("e7", "p7", 1, "x"), 9: ("e4", "p2", 5, "y")}
    new = frames(spark, a, {})
    ids = spark.createDataFrame([(2,), (9,), (99,)], "id long")  # an update, an insert, an id that never was
    got, after = remerge_or(result, state, new, spec(), {"a": ids}, IDS, ORDER)
    assert {r["_row_id"] // 2: r["entity_id"] // 2 for r in after.collect()} == {1: 1, 2: 2, 9: 2, 3: 2, 4: 2, 7: 7}
    assert rows(got) == rows(merge(new, spec(), ids=IDS, order_by=ORDER))


def test_nothing_changed_and_errors(spark):
    src = frames(spark, {1: ("e", None, 1, "x")}, {})
    result, state = merge(src, spec(), ids=IDS, order_by=ORDER), or_state(src, spec(), IDS)
    assert remerge_or(result, state, src, spec(), {}, IDS, ORDER) == (result, state)
    none = src["a"].select("id").filter(F.lit(False))
    assert rows(remerge_or(result, state, src, spec(), {"a": none}, IDS, ORDER)[0]) == rows(result)
    with pytest.raises(SpecError):
        or_state(src, spec(), {"a": "id"})
