import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from keymerge.llm.common import stored, table
from tests.llm.test_near_duplicates import brute
from tests.llm.test_quality import brute as counts
from tests.llm.test_secrets import PLANTED

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage but the last, and the last one's."""
    docs = table(spark, SF, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    return out


def test_classifier_and_rules(spark, steps):
    raw, good, ruled = steps[:3]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(r.doc_id in kept for r in raw if labels.get(r.doc_id) == 0) <= 0.05 * sum(q == 0 for q in labels.values())
    left = {r.doc_id for r in ruled}
    assert left <= kept
    for r in good:
        n, _, _, _, repeated = counts(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert r.doc_id not in left
        elif labels.get(r.doc_id) == 1:
            assert r.doc_id in left


def test_one_of_each_group_stays(steps):
    before, after = steps[2:4]
    _, component = brute([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))


def test_secrets_are_masked(steps):
    before, after = ({r.doc_id: r for r in s} for s in steps[3:5])
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i].text != after[i].text}
    assert {i for i, r in before.items() if PLANTED.search(r.text)} <= changed
    assert not any(PLANTED.search(r.text) for r in after.values())
    assert all(after[i].n_chars == len(after[i].text) for i in changed)


def test_all_tokens_are_packed(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    got = {}
    for p in steps[5]:
        got.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4")))
    texts = {r.doc_id: r.text for r in steps[4]}
    assert got.keys() == texts.keys()
    for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        assert np.concatenate([x for _, x in sorted(got[i], key=lambda p: p[0])]).tolist() == [*e.ids, 1]


def test_odd_and_empty_documents(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stored(stage(spark, docs, SF), name)
            assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns


def test_repeated_rows_leave_one(spark):
    rows = [(1, "some words that are here for the first time"), (1, "some words that are here for the first time"), (2, "another one"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 2]


def test_several_texts_of_an_id(spark):
    """Only the copies go: the other texts of their ids stay, also those of the id that is kept."""
    copy = " ".join(f"word{i}" for i in range(60))
    near = copy + " more"
    others = {i: " ".join(f"t{i}x{k}" for k in range(30)) for i in range(1, 5)}
    rows = [(1, copy), (1, near), (2, copy), (3, near), (3, near)] + list(others.items()) + [(4, others[4]), (1, " "), (1, " "), (1, None), (None, copy)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    stay = [(i, t) for i, t in left if t in others.values()]
    assert sorted(stay) == sorted(others.items())
    rest = [x for x in left if x not in stay]
    assert len(rest) == 4 and {(1, " "), (1, None), (None, copy)} < set(rest)
    assert sum(x in ((1, copy), (1, near)) for x in rest) == 1
