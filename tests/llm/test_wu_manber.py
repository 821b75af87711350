import random
import re
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from keymerge.llm import wu_manber
from keymerge.llm.catalog import QUERIES
from tests.llm.conftest import SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width):
    """Number of words, hit word numbers and items, by comparing every window at every place."""
    w = words(text)
    hit, names, places = set(), set(), {}
    for name, item in items:
        v = words(item)
        for k in range(max(1, len(v) - width + 1) if v else 0):
            window = tuple(v[k : k + width])
            if len(window) not in places:
                places[len(window)] = {}
                for i in range(len(w) - len(window) + 1):
                    places[len(window)].setdefault(tuple(w[i : i + len(window)]), []).append(i)
            for i in places[len(window)].get(window, ()):
                hit.update(range(i, i + len(window)))
                names.add(name)
    return len(w), hit, sorted(names)


def spanned(spans):
    return {k for a, b in spans for k in range(a, b + 1)}


def test_search_equals_brute_force():
    rng = random.Random(11)
    vocabulary = ["a", "b", "Ab", "abc", "é", "日本", "x1", "longerword", "other"]
    sep = [" ", "  ", ". ", "\n", "-", "'", "\x00"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice(sep) for _ in range(n))

    for width in (1, 2, 3, 10):
        for _ in range(30):
            items = [(str(k), text(rng.choice((0, 1, 2, 5, 14)))) for k in range(rng.randint(0, 8))]
            texts = [text(rng.choice((0, 1, 3, 40, 200))) for _ in range(12)]
            texts += [t[: rng.randint(0, len(t))] + (items[0][1] if items else "") for t in texts[:4]]
            n, spans, found = wu_manber.Patterns([(a, b.encode()) for a, b in items], width).search([t.encode() for t in texts])
            for k, t in enumerate(texts):
                want = brute(t, items, width)
                assert (int(n[k]), spanned(spans[k]), sorted(found[k])) == want
                assert all(b[0] > a[1] + 1 for a, b in zip(spans[k], spans[k][1:], strict=False))


def test_occurrences_across_stretches_and_overlapping():
    item = " ".join(f"w{k}" for k in range(12))
    text = ("pad " * 3000 + item + " ") * 3 + " ".join(f"w{k}" for k in range(11)) + " " + item
    n, spans, found = wu_manber.Patterns([("7", item.encode())], 10).search([b"", text.encode(), b"w0 w1"])
    assert n.tolist() == [0, len(text.split()), 2] and spans[0] == spans[2] == [] and found[1] == {"7"}
    assert spanned(spans[1]) == brute(text, [("7", item)], 10)[1]
    same = "ab " * 5000
    _, spans, _ = wu_manber.Patterns([("1", b"ab ab ab ab ab ab ab ab ab ab")], 10).search([same.encode()])
    assert spans[0] == [(0, 4999)]


def test_shifts_skip_most_positions():
    item = " ".join(f"benchmark{k} question{k}" for k in range(30))
    p = wu_manber.Patterns([("1", item.encode())], 10).classes
    assert len(p) == 1 and np.mean(p[0].shift) > 0.9 * (p[0].least - p[0].block + 1)


def check(rows, docs, items):
    texts = {r.doc_id: r.text for r in docs}
    for r in rows:
        n, hit, names = brute(texts[r.doc_id], items, 10)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(names), bool(hit))
        assert r.items_sha256 == sha256(",".join(names).encode()).hexdigest()


def test_query(spark, documents):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = QUERIES["op11_wu_manber"](spark, SF).collect()
    assert len(rows) == documents.count()
    check(rows, documents.collect(), items)


def test_passes_over_blocks_give_the_same(spark, documents, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(documents.limit(3).select(F.lit(None).cast("long").alias("item_id"), "text"))
    want = sorted(wu_manber.digest(wu_manber.find_passages(documents, bench)).collect())
    monkeypatch.setattr(wu_manber, "PASS_BYTES", 1500)
    assert sorted(wu_manber.digest(wu_manber.find_passages(documents, bench)).collect()) == want


def test_odd_tables(spark, odd, empty):
    bench = odd.select(F.col("doc_id").alias("item_id"), "text", "lang", "score")
    items = [("" if r.item_id is None else str(r.item_id), r.text or "") for r in bench.filter("item_id is null or item_id not in (5, 6)").collect()]
    some = bench.filter("item_id is null or item_id not in (5, 6)")
    found = wu_manber.find_passages(odd, some)
    assert found.columns == [*odd.columns, "n_words", "spans", "items"] and found.count() == odd.count()
    for r in wu_manber.find_passages(odd.select("doc_id", "text"), some).collect():
        n, hit, names = brute(r.text, items, 10) if r.doc_id not in (5, 6) else (None, None, None)
        if n is not None:
            assert (r.n_words, {k for s in r.spans for k in range(s.first, s.last + 1)}, r["items"]) == (n, hit, names)
    assert wu_manber.digest(wu_manber.find_passages(empty, some)).count() == 0
    none = wu_manber.digest(wu_manber.find_passages(odd, bench.limit(0))).collect()
    assert len(none) == odd.count() and not any(r.n_hit or r.n_items for r in none)
    long = wu_manber.digest(wu_manber.find_passages(odd, bench.filter("item_id = 5"))).filter("doc_id in (5, 6)").collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in long) == [(5, 40000, 40000), (6, 40001, 40000)]


def test_clean_drops_only_hit_documents(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in QUERIES["op11_wu_manber"](spark, SF).filter("contaminated").collect()}
    kept = wu_manber.clean(documents, bench)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect()} - hit
