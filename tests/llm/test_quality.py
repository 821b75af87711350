import zlib
from collections import Counter

import numpy as np

from keymerge.llm import quality_model, quality_rules
from keymerge.llm.catalog import QUERIES
from keymerge.llm.common import table
from tests.llm.conftest import SF

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    """The five counts, plainly."""
    text = text or ""
    words = split(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_over_the_whole_table(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, SF).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        g, want = got[r.doc_id], brute(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.kept and g.base_failed)


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, sf).collect()}
    labels = table(spark, sf, "labels").collect()
    assert all(not got[r.doc_id].kept for r in labels if r.quality == 0)
    assert all(got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed)


def test_sketches_merge_exactly(spark):
    stats = quality_rules.document_stats(table(spark, "/root/testdata/sf0.01", "documents"))
    whole = quality_rules.merge_sketches(quality_rules.quantile_sketches(stats), "lang")
    odd, even = (quality_rules.quantile_sketches(stats.filter(f"doc_id % 2 = {k}")) for k in (0, 1))
    parts = quality_rules.merge_sketches(odd.unionByName(even), "lang")
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_small_groups_take_their_language(spark):
    rows = [(i, "a b c " * 30 + "#" * (i % 3), "en", "big") for i in range(300)] + [(1000, "a b c " * 30, "en", "tiny"), (1001, "x", None, None)]
    stats = quality_rules.document_stats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    fences = {(r.lang, r.source): r for r in quality_rules.adaptive_fences(stats).collect()}
    assert len(fences) == 3
    assert fences["en", "tiny"].max_symbol_ratio == fences["en", "big"].max_symbol_ratio


def test_adaptive_rules_reject_what_the_base_rule_keeps(spark):
    """In a group without repeats, 45 % of the words in repeated windows or half of the lines repeated are too much."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "clean") for i in range(200)]
    repeats = " ".join(["a b c"] * 9 + [f"v{k}" for k in range(33)])  # 27 of 60 words
    lines = "\n".join(x for k in range(30) for x in [f"l{k} m{k}"] * 2)  # half of the lines; no window of three words occurs twice
    df = spark.createDataFrame([*rows, (1000, repeats, "en", "clean"), (1001, lines, "en", "clean")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert not got[1000].base_failed and got[1000].broken == "repeat_ratio"
    assert "dup_line_ratio" in got[1001].broken.split(",")
    assert all(got[i].kept for i in range(200))
    # A group whose upper decile is higher has a higher fence.
    mixed = [(i, " ".join(["a b c"] * (6 if i % 8 == 0 else 0) + [f"w{i}x{k}" for k in range(60)]), "en", "mixed") for i in range(200)]
    both = quality_rules.document_stats(spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string, source string"))
    fences = {r.source: r.max_repeat_ratio for r in quality_rules.adaptive_fences(both).collect()}
    assert fences["clean"] < fences["mixed"] < 0.5


def test_rules_on_odd_tables(odd, empty):
    rows = quality_rules.apply_rules(odd).collect()
    want = sorted((r.doc_id or 0, *brute(r.text)) for r in odd.collect())
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert quality_rules.apply_rules(empty).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.keep_good(empty).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op2_ftrl_quality"](spark, sf).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in table(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    assert len(held) > 500
    assert np.mean([p == q for p, q in held]) > 0.99
    assert sum(p == 0 and q == 1 for p, q in held) <= 0.005 * len(held)


def test_classifier_over_the_whole_table(spark, documents):
    rows = QUERIES["op2_ftrl_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = (quality_model.train(docs, x).weights for x in (labels, flipped))
    assert np.array_equal(a, b)


def test_ftrl_learns_and_stays_sparse():
    model, rng = quality_model.Ftrl(8), np.random.default_rng(0)
    for _ in range(400):
        good = rng.random() < 0.5
        model.update(np.array([0 if good else 1, 8]), np.array([1.0, 1.0]), float(good))
    w = model.weights()
    assert w[0] > 1 and w[1] < -1 and not w[2:8].any()


def test_classifier_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (13, 0), (None, 1), (5, None), (1, 1)], "doc_id long, quality int")
    rows = quality_model.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 1.0 for r in quality_model.classify(odd, labels.limit(0)).collect())
    assert quality_model.classify(empty, labels).count() == 0
    model = quality_model.train(odd, labels)
    assert quality_model.keep_good(odd, model).columns == odd.columns


def test_shape_reads_the_whole_word():
    assert quality_model.shape(b"a" * 50 + b"!9") == b"a!0" and quality_model.shape("é".encode() * 60 + b"X") == b"aA"


def brute_fences(stats, min_group):
    """Quantiles of binned values by sorting them, group by group."""
    q = quality_rules
    parts = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
             "mark_ratio": ("n_marks", "word_chars"), "upper_ratio": ("n_upper", "n_letters")}
    ratio = {k: [r[a] / max(r[b], 1) for r in stats] for k, (a, b) in parts.items()}

    def fence(metric, rows):
        values = np.array(sorted(ratio[metric][i] for i in rows))
        binned = np.where(values < q.SMALLEST, 0.0, q.GAMMA ** np.ceil(np.log(np.maximum(values, q.SMALLEST)) / np.log(q.GAMMA)))
        q1, q3, q9 = (binned[int(np.ceil(x * len(binned))) - 1] for x in (0.25, 0.75, 0.9))
        least, most = q.SLACK[metric]
        return q3 + max(q.SPREAD * (q3 - q1), min(most, max(least, q.TAIL * (q9 - q1))))

    by = {}
    for i, r in enumerate(stats):
        for key in ((r.lang, r.source), r.lang, "all of them"):
            by.setdefault(key, []).append(i)
    kept = []
    for i, r in enumerate(stats):
        rows = next(by[k] for k in ((r.lang, r.source), r.lang, "all of them") if len(by[k]) >= min_group or k == "all of them")
        broken = [m for m in parts if ratio[m][i] > fence(m, rows)]
        kept.append((r.doc_id, not broken and r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words, ",".join(broken)))
    return sorted(kept)


def test_verdicts_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    stats = quality_rules.document_stats(docs).collect()
    for min_group in (10, 100):
        got = sorted((r.doc_id, r.kept, r.broken) for r in quality_rules.apply_rules(docs, min_group).collect())
        assert got == brute_fences(stats, min_group)


def python_score(text, weights):
    """A score by plain integers and sums, feature by feature."""
    import itertools
    import math

    import xxhash

    full, bits = (1 << 64) - 1, quality_model.SLOT_BITS

    def hashed(b):
        return xxhash.xxh3_64_intdigest(b)

    def slot(x):
        x &= full
        return (((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & full) >> (64 - bits)

    def sort(c):
        return b"A" if 65 <= c <= 90 else b"a" if 97 <= c <= 122 or c >= 128 else b"0" if 48 <= c <= 57 else bytes([c])

    words = (text or "").encode().split()
    h = [hashed(w) for w in words]
    s = [hashed(b"".join(k for k, _ in itertools.groupby(map(sort, w)))) for w in words]
    order = 0x9E3779B97F4A7C15
    slots = [slot(a + hashed(b"word")) for a in h] + [slot(a + hashed(b"shape")) for a in s]
    slots += [slot((a * order & full) + b + hashed(b"pair")) for a, b in zip(h, h[1:])]
    slots += [slot((a * order & full) + b + hashed(b"shapes")) for a, b in zip(s, s[1:])]
    slots += [hashed(b"<same>") >> (64 - bits)] * sum(a == b for a, b in zip(h, h[1:]))
    slots += [hashed(b"<again>") >> (64 - bits)] * brute(text)[4]
    dot = weights[-1] + (math.fsum(weights[x] for x in slots) / len(words) if words else 0)
    return 1 / (1 + math.exp(-dot))


def test_scores_equal_plain_python(spark, documents, odd):
    model = quality_model.train(documents, table(spark, SF, "labels"))
    for docs in (documents, odd):
        want = sorted((r.doc_id or 0, python_score(r.text, model.weights)) for r in docs.collect())
        got = sorted((r.doc_id or 0, r.score) for r in quality_model.score(docs, model).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9)
    query = {r.doc_id: r.score for r in QUERIES["op2_ftrl_quality"](spark, SF).collect()}
    assert np.allclose([query[r.doc_id] for r in documents.collect()], [python_score(r.text, model.weights) for r in documents.collect()], atol=1e-9)
