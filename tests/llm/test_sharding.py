import random
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from keymerge.llm import sharding
from keymerge.llm.catalog import QUERIES


def brute(items, shards):
    """Best fit decreasing by scanning all shards."""
    order = sorted(items, key=lambda x: (-x[0], x[1:]))
    total, alone = sum(x[0] for x in order), 0
    while alone < min(shards - 1, len(order)) and order[alone][0] * (shards - alone) > total:
        total -= order[alone][0]
        alone += 1
    room = {s: -(-total // (shards - alone)) for s in range(alone, shards)}
    place = {x: i for i, x in enumerate(order[:alone])}
    for x in order[alone:]:
        fits = [(r, s) for s, r in room.items() if r >= x[0]]
        s = min(fits)[1] if fits else max((r, s) for s, r in room.items())[1]
        room[s] -= x[0]
        place[x] = s
    return place


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 9))
def test_tree_equals_scan(sizes, shards):
    items = [(s, i) for i, s in enumerate(sizes)]
    assert sharding.best_fit_decreasing(items, shards) == brute(items, shards)


def check(rows, texts, shards):
    """Sizes, slots and indivisible groups; returns the bytes of each shard."""
    load, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text or "").encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[text].add(r.shard)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    total = sum(load.values())
    weight = defaultdict(int)
    for r in rows:
        weight[texts[r.doc_id]] += r.size
    assert all(len(g) == 1 for t, g in groups.items() if weight[t] <= total / shards)
    return load


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_sharding"](spark, sf).collect()
    assert len(rows) == len(texts)
    load = check(rows, texts, 40)
    assert len(load) == 40 and max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 40


def test_small_groups_in_chunks_and_a_huge_group(spark):
    rng = random.Random(2)
    texts = {i: f"{i} " + "x" * rng.randint(1, 60) for i in range(30_000)}
    texts |= {40_000 + i: "the same text again and again" for i in range(15_000)}
    rows = sharding.shard(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shards=5).collect()
    load = check(rows, texts, 5)
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 5


def test_odd_tables(odd, empty):
    rows = sharding.shard(odd, shards=3).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows} <= {0, 1, 2}
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert sharding.shard(empty).count() == 0


def test_many_rows_of_one_id_fill_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    rows = [(7, f"text {k % 40}") for k in range(600)] + [(None, "none")] * 100 + [(k, f"other {k}") for k in range(1000, 1100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 800
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
