"""Type ranges that tolerate stray values (T7) against the programme on one machine and against all divisions."""

import itertools
import random

import numpy as np
import pytest

from keymerge.functions.semantic import SEMANTIC_TYPES
from keymerge.operators.segments import noisy_ranges, segment
from keymerge.operators.types import type_ranges


def costs(runs):
    out = np.zeros((len(runs), len(SEMANTIC_TYPES)), np.int64)
    for k, (n, t) in enumerate(runs):
        if t is not None:
            out[k] = n
            out[k, SEMANTIC_TYPES.index(t)] = 0
    return out


def price(costs, labels, penalty):
    return sum(c[j] for c, j in zip(costs, labels)) + penalty * sum(a != b for a, b in zip(labels, labels[1:]))


def test_the_programme_finds_the_cheapest_division():
    rng = random.Random(5)
    for _ in range(40):
        runs = [(rng.randint(1, 4), rng.choice(["boolean", "email", None])) for _ in range(7)]
        c, penalty = costs(runs), rng.randint(1, 5)
        best = min(price(c, list(x), penalty) for x in itertools.product((0, 1), repeat=len(runs)))
        assert price(c, segment(c, penalty).tolist(), penalty) == best


@pytest.mark.parametrize("partitions,penalty", [(1, 3), (7, 3), (40, 1), (13, 10)])
def test_partitions_equal_one_machine(spark, partitions, penalty):
    rng = random.Random(partitions)
    runs, kind = [], None
    for _ in range(120):
        kind = rng.choice([t for t in ["integer", "email", "text", "name", None] if t != kind])
        runs.append((rng.choice([1, 1, 2, 9, 30]), kind))
    rows, at = [], 1
    for n, t in runs:
        rows.append((at, n, t))
        at += n
    labels = segment(costs(runs), penalty).tolist()
    want = []
    for _, part in itertools.groupby(zip(rows, labels), key=lambda x: x[1]):
        part = list(part)
        label = SEMANTIC_TYPES[part[0][1]]
        typed = sum(n for (_, n, t), _ in part if t is not None)
        hits = sum(n for (_, n, t), _ in part if t == label)
        size = sum(r[1] for r, _ in part)
        want.append((part[0][0][0], part[0][0][0] + size - 1, size, label if typed else None, hits / typed if typed else None))
    df = spark.createDataFrame(rows, "start_row long, n_rows long, semantic_type string").repartition(4)
    assert sorted(map(tuple, noisy_ranges(df, penalty, partitions).collect())) == want


def test_strays_stay_in_their_range(spark):
    values = ["1", "2", "x y z!", "4", None, "6"] + ["a@b.org"] * 5 + ["7"] + ["c@d.org"] * 4 + [None]
    df = spark.createDataFrame(list(enumerate(values)), "o int, v string")
    got = [tuple(r) for r in type_ranges(df, "v", "o", partitions=3, penalty=2).orderBy("start_row").collect()]
    assert got == [("v", 1, 6, 6, "integer", 0.8), ("v", 7, 17, 11, "email", 0.9)]
    nothing = spark.createDataFrame([(1, None), (2, "")], "o int, v string")
    assert [tuple(r) for r in type_ranges(nothing, "v", "o", penalty=2).collect()] == [("v", 1, 2, 2, None, None)]
    assert type_ranges(df.limit(0), "v", "o", penalty=2).count() == 0
