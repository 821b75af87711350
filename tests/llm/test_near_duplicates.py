import numpy as np

from keymerge.llm import lattice, minhash
from keymerge.llm.catalog import QUERIES
from keymerge.llm.common import table
from keymerge.llm.quality_rules import WordHashes
from tests.llm.conftest import SF
from tests.llm.test_quality import split


def groups(ids, linked):
    """Smallest id reachable, by plain union-find over all pairs."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, width):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in split(text or "")]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width):
    sets = {i: shingle_set(t, width) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k]
              if min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b]))
              and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, groups(list(sets), linked)


def test_minhash_over_the_whole_table(spark, documents):
    sets, component = brute([(r.doc_id, r.text) for r in documents.collect()], 2)
    rows = QUERIES["op4_superminhash"](spark, SF).collect()
    assert len(rows) == len(sets)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], component[r.doc_id] == r.doc_id)


def test_large_family_of_near_copies(spark):
    """A family larger than a task's block; many members are similar to some but not to the first."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(words)
        for k in rng.choice(60, rng.integers(0, 6), replace=False):
            w[k] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    sets, component = brute(rows, 2)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == component


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = (np.unique(np.append(common, rng.integers(0, 2**63, 50, dtype=np.uint64))) for _ in range(2))
    sig = minhash.signatures([a, b], 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.05
    # All ranks of a single element are used: its values are one in each unit interval.
    one = np.sort(minhash.signatures([a[:1]], 64)[0])
    assert np.array_equal(np.floor(one), np.arange(64))


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 7, 60, 500, 3000)]
    together = minhash.signatures(sets)
    for s, row in zip(sets, together, strict=True):
        assert np.array_equal(minhash.signatures([s])[0], row)


def test_shingles_of_short_and_cased_texts():
    h = WordHashes()
    one = minhash.shingles(b"Word", 2, h)
    assert len(one) == 1 and np.array_equal(one, minhash.shingles(b" wORD\n", 2, h))
    assert len(minhash.shingles(b"a b a b", 2, h)) == 2
    assert not np.array_equal(minhash.shingles("\u00c9".encode(), 2, h), minhash.shingles("\u00e9".encode(), 2, h))


def test_minhash_on_odd_tables(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == odd.count()
    assert [r.component_id for r in by[8] + by[9]] == [8, 8, 8] and [r.kept for r in by[9]] == [False, False]
    assert sorted((r.component_id, r.kept) for r in by[None] if r.n_shingles) == [(8, False)]
    assert all(r.kept and not r.n_shingles for i in (2, 3, 4) for r in by[i])
    assert by[6][0].component_id == 5
    assert minhash.near_duplicates(empty).count() == 0


def brute_vectors(rows):
    out, links = {}, []
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for k, (a, x) in enumerate(good):
        for b, y in good[:k]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links.append((a, b))
    for a, b in links:
        out[a] = out.get(a, 0) + 1
        out[b] = out.get(b, 0) + 1
    return out, groups([i for i, _ in rows], links)


def test_lattice_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    links, component = brute_vectors(rows)
    got = QUERIES["op3_e8_lattice"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), component[r.vec_id], component[r.vec_id] == r.vec_id)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of just over 0.95, the hardest ones, and a large family."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        x = rng.normal(size=32)
        x /= np.linalg.norm(x)
        z = rng.normal(size=32)
        z -= z @ x * x
        rows += [(2 * i, x.tolist()), (2 * i + 1, (0.951 * x + np.sqrt(1 - 0.951**2) * z / np.linalg.norm(z)).tolist())]
    base = rng.normal(size=32)
    rows += [(10_000 + i, (base + 0.02 * rng.normal(size=32)).tolist()) for i in range(1500)]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[2 * i].n_links == 1 for i in range(400)) >= 396
    assert all(got[10_000 + i].n_links == 1499 and got[10_000 + i].component_id == 10_000 for i in range(1500))


def test_one_near_pair_in_a_large_cell(spark, monkeypatch):
    """Cells of several blocks whose only near pair lies within one of them: it counts once."""
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(16):
        base = rng.normal(size=64)
        x = base / np.linalg.norm(base) + 0.045 * rng.normal(size=(60, 64))
        rows += [*x, x[0] + 0.002 * rng.normal(size=64)]
    u = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert 32 <= near.sum() < 64
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(len(rows))] == near.tolist()


def test_nearest_lattice_point():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(200, 8)) * 2
    near = lattice.nearest_e8(y)
    twice = np.rint(2 * near)
    assert np.array_equal(twice, 2 * near) and not (near.sum(axis=1) % 2).any()
    assert ((twice % 2 == 0).all(axis=1) | (twice % 2 == 1).all(axis=1)).all()
    gap = ((y - near) ** 2).sum(axis=1)
    for v in lattice.neighbours():
        assert (((y - near - v) ** 2).sum(axis=1) >= gap - 1e-12).all()


def test_lattice_on_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [1.0, 2.0]), (9, [1.0, 2.0]), (None, [1.0, 2.0]), (None, None), (10, [1.0, 2.0, 0.0]), (11, [1e200, 2e200]), (12, [-1.0, -2.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, node int, n_links string")
    got = lattice.near_vectors(df).collect()
    assert len(got) == len(rows)
    linked = [r for r in got if r.n_links]
    assert {r.vec_id for r in linked} == {1, 2, 9, None, 11} and all(r.n_links == 5 and r.component_id == 1 for r in linked)
    assert all(r.component_id == r.vec_id for r in got if not r.n_links)
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_plan_grows_with_the_table():
    assert lattice.plan(1000, 64).points == 1
    big = lattice.plan(10**9, 64)
    assert big.points > 1 and big.tables > lattice.plan(1000, 64).tables


def test_recall_just_above_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.86 by random edits, each pair with words of its own: nearly all are linked, none below."""
    rng = np.random.default_rng(17)
    rows, wanted = [], 0
    for p in range(320):
        words = [f"p{p}w{i}" for i in range(120)]
        other = list(words)
        for k in rng.choice(120, rng.integers(4, 8), replace=False):
            other[k] = f"p{p}x{k}"
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    sets, component = brute(rows, 2)
    wanted = sum(component[2 * p + 1] == 2 * p for p in range(320))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    hit = sum(found[2 * p + 1] == 2 * p for p in range(320) if component[2 * p + 1] == 2 * p)
    assert wanted > 100 and hit >= 0.99 * wanted
    assert all(found[i] == i for i, c in component.items() if c == i)


def test_members_unlike_the_first_meet_members_like_it(spark, monkeypatch):
    """One bucket: x is like the first member, y is like x alone; blocks of two so that several are compared."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rng = np.random.default_rng(2)
    first = rng.integers(0, 60000, minhash.SLOTS).astype(np.uint16)
    rows, key = [], bytearray(b"\x00" * 16)

    def mixed(a, share):
        out = a.copy()
        out[: int(len(a) * (1 - share))] = rng.integers(0, 60000, int(len(a) * (1 - share)))
        return out

    like = [mixed(first, 0.9) for _ in range(5)]
    unlike = [mixed(first, 0.1), np.concatenate([like[3][:40], rng.integers(0, 60000, 24).astype(np.uint16)])]
    for i, s in enumerate([first, *like, *unlike]):
        key[0] = i
        rows.append((bytes(key), s.tobytes(), [7]))
    classes = spark.createDataFrame(rows, "node binary, prints binary, keys array<long>")
    links = {tuple(sorted((bytes(r.a)[0], bytes(r.b)[0]))) for r in minhash._likely(classes, 0.55).collect()}
    assert {(0, k) for k in range(1, 6)} <= links and (4, 7) in links and not any(6 in x for x in links)
