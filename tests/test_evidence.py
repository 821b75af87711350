"""Why rows are one entity (Q5): every path checked against the edges, depths against a breadth-first search."""

import random
from collections import defaultdict, deque

import pytest

from keymerge.operators.entities import Link, resolve
from keymerge.operators.evidence import explain_entities, link_edges, link_paths
from keymerge.spec import SourceField


def depths(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, seen = {}, set()
    for root in sorted(near):
        if root in seen:
            continue
        queue, dist = deque([root]), {root: 0}
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        seen |= set(dist)
        out.update({x: (root, d) for x, d in dist.items() if d})
    return out


@pytest.mark.parametrize("local", [0, 200_000])
def test_paths_follow_edges_and_are_shortest(spark, local):
    rng = random.Random(local)
    rows = {(rng.randint(0, 70), rng.randint(0, 70), rng.randint(0, 2), f"v{rng.randint(0, 5)}") for _ in range(75)} | {(k, k + 1, 0, "chain") for k in range(200, 206)}
    got = link_paths(spark.createDataFrame(sorted(rows), "src long, dst long, link int, value string").repartition(3), local_links=local).collect()
    want = depths([(a, b) for a, b, _, _ in rows if a != b])
    assert {r["_row_id"]: (r.entity_id, r.depth) for r in got} == want and len(got) == len(want)
    edges = rows | {(b, a, n, v) for a, b, n, v in rows}
    for r in got:
        assert (r["_row_id"], r.parent, r.link, r.value) in edges
        assert r.depth == (want[r.parent][1] if r.parent in want else 0) + 1
        better = [(a, n, v) for a, b, n, v in edges if b == r["_row_id"] and a != b and (want[a][1] if a in want else 0) == r.depth - 1]
        assert min(better) == (r.parent, r.link, r.value)


def test_links_of_all_kinds(spark):
    crm = spark.createDataFrame([(1, "a@x.org", "anna berg", "p1"), (2, "b@x.org", "anna berk", "p2"), (3, None, "zed", "p2"), (9, "q@q.org", "otto", None)], "id long, mail string, name string, phone string")
    web = spark.createDataFrame([(1, "a@x.org"), (2, "a@x.org"), (3, "nobody@x.org")], "id long, email string")
    links = [Link("crm", "mail", "web", "email"), Link("crm", "name", "crm", "name", kind="fuzzy", threshold=80, compare_all=True)]
    keys, ids = [[SourceField("crm", "phone")]], {"crm": "id", "web": "id"}
    rows = explain_entities({"crm": crm, "web": web}, links, keys, ids).collect()
    got = {r["_row_id"]: (r.entity_id, r.parent, r.link, r.value, r.depth) for r in rows}
    assert got == {3: (2, 2, 0, "a@x.org", 1), 5: (2, 2, 0, "a@x.org", 1), 4: (2, 2, 1, "anna berg ~ anna berk", 1), 6: (2, 4, 2, "p2", 2)}
    entity = {r["_row_id"]: r["entity_id"] for r in resolve({"crm": crm, "web": web}, links, ids=ids, key_fields=keys).collect()}
    assert all(entity[i] == g[0] for i, g in got.items())


def test_no_links(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert explain_entities({"s": df}, [Link("s", "v", "s", "v")], ids={"s": "id"}).count() == 0
    assert link_edges({"s": df.limit(0)}, [Link("s", "v", "s", "v")], ids={"s": "id"}).count() == 0
