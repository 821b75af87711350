"""Bounded clusters from weighted links (E6) against a sequential capped union-find."""

import random
from collections import Counter

from keymerge.operators.clusters import bounded_components


def sequential(links, bound):
    best = {}
    for a, b, w in links:
        best[min(a, b), max(a, b)] = max(w, best.get((min(a, b), max(a, b)), w))
    cluster = {x: {x} for a, b, _ in links for x in (a, b)}
    for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        x, y = cluster[a], cluster[b]
        if x is not y and len(x) + len(y) <= bound:
            x |= y
            for n in y:
                cluster[n] = x
    return {n: min(c) for n, c in cluster.items()}


def shapes():
    rng = random.Random(6)
    yield "random", [(rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 9) / 10) for _ in range(150)], 7
    yield "equal weights", [(rng.randint(0, 40), rng.randint(0, 40), 1.0) for _ in range(60)], 5
    yield "hub", [(0, k, 1.0) for k in range(1, 60)] + [(k, k + 1, 0.5) for k in range(1, 59)], 6
    yield "path down", [(k, k + 1, 1 - k / 100) for k in range(40)], 4
    yield "path of equals", [(k, k + 1, 1.0) for k in range(30)], 3
    yield "two blobs and a weak bridge", [(a, b, 0.9) for o in (0, 10) for a in range(o, o + 6) for b in range(a + 1, o + 6)] + [(5, 10, 0.1)], 6
    yield "within the bound", [(1, 2, 0.5), (2, 3, 0.1), (9, 9, 1.0)], 3


def check(spark, links, bound, local, name):
    want = sequential(links, bound)
    df = spark.createDataFrame(links, "src long, dst long, weight double").repartition(3)
    rows = bounded_components(df, bound, local_links=local).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want), name
    assert max(Counter(r.component for r in rows).values()) <= bound


def test_equal_to_sequential(spark):
    for name, links, bound in shapes():
        check(spark, links, bound, 200_000, name)


def test_rounds_equal_to_sequential(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 25), rng.randint(0, 25), rng.randint(1, 9) / 10) for _ in range(50)]
    links += [(100, k, 1.0) for k in range(101, 130)] + [(k, k + 1, 0.5) for k in range(101, 129)]  # a hub
    check(spark, links, 6, 0, "rounds only")


def test_weak_bridge_is_cut_and_marked(spark):
    links = [(a, b, 0.9) for o in (0, 10) for a in range(o, o + 6) for b in range(a + 1, o + 6)] + [(5, 10, 0.1), (50, 51, 0.2)]
    rows = bounded_components(spark.createDataFrame(links, "src long, dst long, weight double"), 7).collect()
    assert {r.node: (r.component, r.split) for r in rows} == {**{n: (0, True) for n in range(6)}, **{n: (10, True) for n in range(10, 16)},
                                                                50: (50, False), 51: (50, False)}


def test_text_nodes_and_no_links(spark):
    rows = bounded_components(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.9), ("c", "d", 1.0)], "src string, dst string, weight double"), 2).collect()
    assert {r.node: r.component for r in rows} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert bounded_components(spark.createDataFrame([], "src long, dst long, weight double"), 2).count() == 0


def test_fuzzy_links_are_cut_by_similarity(spark):
    from keymerge.operators.entities import Link, resolve

    names = ["anna berg", "anna berk", "anne berk", "anne birk", "otto moll", "otto moll", "otto mohl"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    link = Link("s", "name", "s", "name", kind="fuzzy", threshold=75, compare_all=True)
    whole = {r[0]: r[1] for r in resolve({"s": df}, [link], ids={"s": "id"}).select("_row_id", "entity_id").collect()}
    assert whole == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4}
    cut = {r[0]: r[1] for r in resolve({"s": df}, [link], ids={"s": "id"}, max_cluster_size=2, oversize="split").select("_row_id", "entity_id").collect()}
    assert cut == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}


def test_two_columns_of_one_source(spark):
    from keymerge.operators.entities import Link, resolve

    rows = [(1, "a", "b"), (2, "b", "x"), (3, "c", "c"), (4, "d", None), (5, None, "d"), (6, "e", "e2"), (7, "e", "e3"), (8, "z", "c")]
    df = spark.createDataFrame(rows, "id long, l string, r string")
    got = {r[0]: r[1] for r in resolve({"s": df}, [Link("s", "l", "s", "r")], ids={"s": "id"}).select("_row_id", "entity_id").collect()}
    # 1-2 by b, 3-8 by c, 4-5 by d; two equal values on the left alone link nothing.
    assert got == {1: 1, 2: 1, 3: 3, 8: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    fuzzy = Link("s", "l", "s", "r", kind="fuzzy", threshold=50, compare_all=True)
    got = {r[0]: r[1] for r in resolve({"s": df}, [fuzzy], ids={"s": "id"}).select("_row_id", "entity_id").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 8: 3, 4: 4, 5: 4, 6: 6, 7: 6}


def test_fuzzy_links_without_blocks_are_a_choice():
    import pytest

    from keymerge import Link, SpecError

    with pytest.raises(SpecError):
        Link("s", "v", "s", "v", kind="fuzzy", threshold=80)
    assert Link("s", "v", "s", "v", kind="fuzzy", threshold=80, compare_all=True).compare_all


def test_no_join_passes_a_table_through_the_driver(spark):
    """Tables of nodes grow with the rows, and a broadcast of one per join and round adds up in the driver."""
    from keymerge.operators.clusters import _relabelled, _round
    from keymerge.operators.entities import Link, resolve
    from keymerge.plans.explain import plan_report
    from keymerge.session import written

    links = written(spark.range(40).selectExpr("id AS a", "id + 1 AS b", "struct(-1D AS w, id AS p, id + 1 AS q) AS k"))
    sizes = written(spark.range(41).selectExpr("id AS label", "1L AS size"))
    moved = _round(links, sizes, 3)
    df = written(spark.range(40).selectExpr("id", "id div 3 AS k1", "id div 7 AS k2"))
    cut = resolve({"s": df}, [Link("s", "k1", "s", "k1"), Link("s", "k2", "s", "k2")], ids={"s": "id"}, max_cluster_size=5, oversize="split")
    for name, part in (("round", moved), ("labels", _relabelled(sizes, "label", written(moved))), ("result", cut.select("_row_id", "entity_id"))):
        assert plan_report(part)["broadcasts"] == 0, name
