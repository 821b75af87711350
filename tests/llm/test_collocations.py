import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from keymerge.llm import collocations
from keymerge.llm.catalog import ORACLE, QUERIES
from tests.llm.conftest import SF


def brute(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(len(w)):
                f[lang].update(tuple(w[k : k + m]) for m in range(1, longest + 1) if k + m <= len(w))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        kept = []
        for p, a in cand.items():
            if p in longer and 100 * longer[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def random_docs(spark):
    rng = random.Random(13)
    words = ["a", "The", "the", "é", "of", "x-1", "日本", "in it", "und", "z"]
    sep = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]
    rows = [(k, None if rng.random() < 0.05 else "".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "en", "de", None])) for k in range(150)]
    rows += [(200 + k, "one passage that is there again and again of the", "en") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark):
    docs = random_docs(spark)
    rows = docs.collect()
    for least, longest, top in ((100, 5, 2000), (10, 5, 2000), (2, 4, 50), (5, 2, 7)):
        assert result(collocations.mine(docs, least, longest, top)) == brute(rows, least, longest, top)


def test_too_frequent_pairs_are_dealt_by_all_their_words(spark, monkeypatch):
    docs = random_docs(spark)
    monkeypatch.setattr(collocations, "HOT", 20)
    assert result(collocations.mine(docs, 10, 5, 500)) == brute(docs.collect(), 10, 5, 500)
    monkeypatch.setattr(collocations, "HOT", 0)
    assert result(collocations.mine(docs, 30, 5, 500)) == brute(docs.collect(), 30, 5, 500)


def test_full_bit_maps_only_cost_work(spark, monkeypatch):
    docs = random_docs(spark)
    everything = collocations.Bits(1 << 16, {0: b"\xff" * 8192})
    nothing = collocations.Bits(1 << 16, {})
    maps = iter([everything, everything, nothing])
    monkeypatch.setattr(collocations, "_bit_map", lambda hashes: next(maps))
    assert result(collocations.mine(docs, 10, 5, 500)) == brute(docs.collect(), 10, 5, 500)


def test_sorting_counts_prefixes_and_abandons():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 4, (3000, 5)).astype(np.int32)
    rows[rng.random(3000) < 0.3, 3:] = -1
    rows[rng.random(3000) < 0.2, 2:] = -1
    weight = rng.integers(1, 4, 3000)
    want = Counter()
    for r, w in zip(rows.tolist(), weight.tolist(), strict=True):
        for d in range(2, 6):
            if r[d - 1] >= 0:
                want[tuple(r[:d])] += w
    for least in (1, 40, 200):
        got = {tuple(rows[p, :d].tolist()): n for p, d, n in collocations.sort_suffixes(rows, weight, least)}
        assert got == {k: n for k, n in want.items() if n >= least}


def test_blocks_end_between_routes(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SORTED_ROWS", 3)
    rows = [("en", r, False, s, n) for r, s, n in [(1, "a b c", 2), (1, "a b", 2), (1, "a b d", 1), (1, "a b c", 1), (5, "x y", 4), (6, "x z", 1), (9, "q r s t u", 3)]]
    schema = pa.schema([("lang", pa.string()), ("route", pa.int64()), ("whole", pa.bool_()), ("suffix", pa.string()), ("n", pa.int64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2], strict=True), schema.types, strict=True)], schema=schema) for k in range(0, len(rows), 2)]
    found = {r["phrase"]: r["n"] for b in collocations._sort(3, 5)(iter(batches)) for r in b.to_pylist()}
    assert found == {"a b": 6, "a b c": 3, "x y": 4, "q r": 3, "q r s": 3, "q r s t": 3, "q r s t u": 3}


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert result(QUERIES["op13_collocations"](spark, SF)) == sorted(con.execute(ORACLE["op13_collocations"]).fetchall())


def test_odd_tables(odd, empty):
    assert result(collocations.mine(odd, 2, 5, 2000)) == brute(odd.select("text", "lang").collect(), 2, 5, 2000)
    assert collocations.mine(empty).count() == 0
