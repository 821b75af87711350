import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keymerge.llm import divergence
from keymerge.llm.catalog import ORACLE, QUERIES
from tests.llm.conftest import SF

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    """All steps in Python integers."""
    found, docs, groups = defaultdict(Counter), Counter(), set()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        found[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(found[lang, s][t] for t in kept) for s in sources}

        def share(n, of):
            return 1 + 10**9 * (n + 2) // (of + 2 * len(kept))

        p = {s: {t: share(found[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(found[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, i, v, k + 1))
    return sorted(out)


def random_docs(spark, n=120):
    rng = random.Random(12)
    words = ["a", "The", "the", "é", "É", "日本語", "x1y", "don't", "Ünder", "zz"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(k, None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None, ""]),
             rng.choice(["s1", "s2", "é", "Z", None])) for k in range(n)]
    rows.append((n, "1 2 3", "xx", "only"))
    rows.append((n + 1, None, "xx", "other"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark):
    docs = random_docs(spark)
    assert result(divergence.audit(docs, least_docs=10, top=10)) == brute(docs.collect(), 10, 10)
    assert result(divergence.audit(docs, least_docs=1, top=2)) == brute(docs.collect(), 1, 2)


def test_small_blocks_and_many_flushes_give_the_same(spark, monkeypatch):
    docs = random_docs(spark)
    want = brute(docs.collect(), 3, 4)
    for name, value in (("TOGETHER", 200), ("HELD_ROWS", 10), ("CELLS", 8), ("HELD_SOURCES", 1)):
        monkeypatch.setattr(divergence, name, value)
    # The functions that tasks run read these from the module they are sent with.
    parts = list(divergence._partial(iter([pa.RecordBatch.from_pydict({"lang": ["a"], "source": ["s"], "text": [t]}) for t in ("x y x", "y" * 300, "Z z")])))
    assert Counter({r["term"]: r["n"] for r in pa.Table.from_batches(parts).to_pylist()})["x"] == 2
    lang = divergence._Language("l", ["a", "b"], [5, 7], 4, 2)
    rows = [("t1", "a", 2), ("t1", "b", 1), ("t2", "b", 4), ("t3", "a", 3), ("t4", "b", 2)]
    whole = divergence._Language("l", ["a", "b"], [5, 7], 4, 2)
    got = [*lang.add(rows[:3]), *lang.add(rows[3:]), *lang.close()]
    monkeypatch.setattr(divergence, "CELLS", 1000)
    one = [*whole.add(rows), *whole.close()]
    assert sum(r[4] for r in got if r[2] == "pair") == sum(r[4] for r in one if r[2] == "pair")
    assert [r for r in got if r[2] == "term"] == [r for r in one if r[2] == "term"]
    assert result(divergence.audit(docs, 3, 4)) == want


def test_share_is_exact_beyond_64_bits():
    count, total = [1, 10**12 + 7, 3 * 10**14 + 1, 7], [3, 10**13 + 1, 10**15 + 3, 7]
    assert divergence._share(np.array(count), np.array(total)).tolist() == [1 + 10**9 * c // t for c, t in zip(count, total, strict=True)]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(ORACLE["op12_arrow_divergence"]).fetchall())
    assert result(QUERIES["op12_arrow_divergence"](spark, SF)) == want


def test_odd_tables(spark, odd, empty):
    assert result(divergence.audit(odd, 1, 3)) == brute(odd.select("text", "lang", "source").collect(), 1, 3)
    assert divergence.audit(empty).count() == 0
    nothing = odd.withColumn("text", F.lit(None).cast("string"))
    rows = result(divergence.audit(nothing))
    assert rows == brute(nothing.select("text", "lang", "source").collect(), 10, 10) and {r[4] for r in rows} == {0}
