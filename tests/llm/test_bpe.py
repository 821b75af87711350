import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from keymerge.llm import bpe
from keymerge.llm.catalog import QUERIES
from tests.llm.conftest import SF

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return bpe.BytePairCoder(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_equals_the_library(coder, library):
    rng = random.Random(5)
    texts = ["", " ", "  a  b ", "\n\n x", "a\x1c b", "it's 's", " lead", "trail ", "=" * 700, "\u00e9" * 50, " " * 300 + "x", "a" * 3000, "\t\tif x:\n  return"]
    texts += ["".join(rng.choice("ab '\n\t.19\u00e9\u3000\x1c\x85\u65e5st") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        assert ids(coder.encode(t)) == library.encode_ordinary(t), t[:60]


def test_appends_and_edits(coder, library):
    rng = random.Random(6)
    for _ in range(200):
        data = "".join(rng.choice("abetionshr") for _ in range(rng.randint(2, 300))).encode()
        grown = bpe.PrefixTable(coder)
        for i in range(0, len(data), 7):
            grown.append(data[i : i + 7])
        whole = bpe.PrefixTable(coder, data)
        assert grown.ids() == whole.ids()
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        new = "".join(rng.choice("tionxyz") for _ in range(rng.randint(0, 9))).encode()
        whole.edit(a, b, new)
        fresh = bpe.PrefixTable(coder, data[:a] + new + data[b:])
        assert (whole.start, whole.token) == (fresh.start, fresh.token)


def test_an_edit_computes_near_it_only(coder):
    table = bpe.PrefixTable(coder, b"the thorn and tion of shth " * 400)
    assert table.edit(50, 52, b"xy") < 2000


def test_query_over_the_whole_table(spark, documents, library):
    got = {r.doc_id: r for r in QUERIES["op8_prefix_bpe"](spark, SF).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = np.array(library.encode_ordinary(r.text), "<u4")
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == sha256(want.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == sha256(r.text.encode()).hexdigest()


def test_odd_tables(odd, empty):
    coded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, RANKS).collect()
    want = sorted((r.doc_id or 0, (r.text or "").encode()) for r in odd.collect())
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == want
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
