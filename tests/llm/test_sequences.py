import os
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keymerge.llm import materialise, packing
from keymerge.llm.bpe import read_ranks
from keymerge.llm.catalog import QUERIES
from keymerge.llm.tokens import ByteTokenizer, WordTokenizer, byte_tokenizer, read_vocabulary, tokenizer
from tests.llm.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
ROOT = Path(__file__).resolve().parents[2]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def byte_ids():
    with open(RANKS[0], "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=RANKS[1], mergeable_ranks=read_ranks(f.read()), special_tokens={})
    return lambda rows: [np.array([*coder.encode_ordinary(r.text or ""), 50256], "<u2") for r in rows]


def all_ids(library, rows):
    texts = library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    return [np.array([*e.ids, 1], "<u4") for e in texts]


def test_words_one_by_one_equal_whole_texts(library):
    rng = random.Random(3)
    texts = ["", "|", " | a|b ", "İstanbul ǅ ß", "á ́ b", "<|endoftext|> a", "b<|startoftext|>C <|ENDOFTEXT|> x <|end", "x" * 500]
    texts += ["".join(rng.choice("ab1 '.,-<|>'’s—…\n") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice("ab '|\n\t.19é　\x1ć日st") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    got = list(tokenizer(read_vocabulary(PATH)).encode(texts))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_whole_texts(spark, documents):
    with open(RANKS[0], "rb") as f:
        coder = byte_tokenizer(f.read(), RANKS[1])
    rng = random.Random(7)
    texts = ["", " ", "  a  b ", "\n\n x", " lead", "trail ", "a\nb c\n", "x\u0085 y", "x" * 300 + " y"] + [r.text for r in documents.collect()]
    texts += ["".join(rng.choice("ab '\n\t.19\u00e9\u3000\x1c\x85\u65e5st") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab'  \n\n\t\r.19\u00e9\x1c\u65e5s\x00\u200b.,-!\u2019\u2014<|>") for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    assert list(coder.encode(texts)) == [np.array(coder.library.encode_ordinary(t), "<u2").tobytes() for t in texts]


SPLIT_WORDS = """
import sys, random
import numpy as np
from keymerge.llm.tokens import byte_tokenizer
coder = byte_tokenizer(open(sys.argv[1], "rb").read(), sys.argv[2])
rng = random.Random(int(sys.argv[3]))
breaks = ["\\n", "\\r\\n", "\\n\\t", "\\x1c", "\\x85", "\\t\\n\\x1c", "\\u2028", ""]
words = ["w%d" % k for k in range(300)] + ["s\\n\\t", "t\\n\\x1c", "\\nq", "x\\ny"]
texts = [" ".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randint(1, 40))) for _ in range(400)]
texts += [" ".join(rng.choice(words) + rng.choice(breaks[:4]) for _ in range(30)) for _ in range(100)]
texts += ["alpha beta\\nr s\\n\\tmany more plain words here and there", "ends\\n", "ends\\r\\n", "a ends\\n\\t", "b ends\\x1c"]
wrong = [t for t, ids in zip(texts, coder.encode(texts)) if ids != np.array(coder.library.encode_ordinary(t), "<u2").tobytes()]
wrong += [w for w, k in coder.number.items()
          if w[:1] == b" " and coder.ids[coder.start[k] : coder.start[k] + coder.length[k]].tolist() != coder.library.encode_ordinary(w.decode())]
assert len(coder.number) > 300
assert not wrong, wrong[:3]
"""


def test_units_survive_forgetting(monkeypatch, library):
    from keymerge.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    monkeypatch.setattr(tokens, "TOGETHER", 300)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(("w", "\n", "")) + str(rng.randint(0, 90)) + "y" * rng.choice((0, 0, 80)) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    coder = WordTokenizer(read_vocabulary(PATH))
    assert list(coder.encode(texts)) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(coder.number) < 200 and max(map(len, coder.number)) <= tokens.LONGEST_KEPT
    with open(RANKS[0], "rb") as f:
        coder = ByteTokenizer(f.read(), RANKS[1])
    assert list(coder.encode(texts)) == [np.array(coder.library.encode_ordinary(t), "<u2").tobytes() for t in texts]
    texts += ["a\u3000 b \u2003"]
    assert coder.count([t.encode() for t in texts]) == sum(len(coder.library.encode_ordinary(t)) for t in texts)


def test_another_pattern_is_coded_in_whole_texts():
    with open(RANKS[0], "rb") as f:
        coder = ByteTokenizer(f.read(), r"\s*[\r\n]+|\S+|\s+")
    texts = ["a b\n\n c", " x\n", ""]
    assert list(coder.encode(texts)) == [np.array(coder.library.encode_ordinary(t), "<u2").tobytes() for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_words_keep_their_own_ids_under_any_hash_seed(seed):
    done = subprocess.run([sys.executable, "-c", SPLIT_WORDS, *RANKS, str(seed)], env={**os.environ, "PYTHONHASHSEED": str(seed)},
                          cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_training_order_keeps_texts_that_end_in_breaks(spark, byte_ids):
    texts = ["alpha beta\nr s\n\tmany more plain words here and there", "one two\n", "one two\r\n", "two three\n\t", "four five\x1c", "beta r t\n\x1c again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    shards = []
    for _ in range(2):
        folder = materialise.training_folder(spark)
        manifest = materialise.write_training_order(docs, *RANKS, folder, key=3, length=16, per_shard=64).orderBy("number").collect()
        records = list(materialise.read_slots(folder, 0, len(manifest), 16))
        shards.append([r.tobytes() for r in records])
    stream = np.concatenate([records[r.slot][: r.length] for r in manifest])
    assert np.array_equal(stream, np.concatenate(byte_ids(docs.orderBy("doc_id").collect())))
    assert shards[0] == shards[1]


def check_pieces(pieces, ids):
    """Every id in one piece, no sequence too long, no gap in a sequence; returns the padding's share."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        assert _joined(parts) == len(ids[i])
    used = [_joined(parts) for parts in by_sequence.values()]
    assert max(used) <= 2048
    return 1 - sum(used) / (2048 * len(used))


def _joined(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at
        at += length
    return at


def test_packing_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = dict(zip([r.doc_id for r in rows], all_ids(library, rows), strict=True))
    assert check_pieces(QUERIES["op6_packing"](spark, sf).collect(), ids) < 0.01


def test_packing_many_partitions_with_ids(spark, documents, library):
    rows = documents.collect()
    ids = dict(zip([r.doc_id for r in rows], all_ids(library, rows), strict=True))
    pieces = packing.pack(documents.repartition(70, F.col("doc_id")), PATH).collect()
    assert check_pieces(pieces, ids) < 0.02
    for p in pieces:
        assert np.array_equal(np.frombuffer(p.ids, "<u4"), ids[p.doc_id][p.start : p.start + p.length])


def test_packer_keeps_few_windows_open():
    rng, packer = random.Random(4), packing.Packer(100, 5, 3)
    total = 0
    for doc in range(2000):
        n = rng.choice((1, 7, 40, 55, 99, 100, 101, 350))
        total += n
        packer.add(doc, b"\0\0\0\0" * n, n)
        assert len(packer.open) <= 5
    used = [sum(len(p[2]) // 4 for p in w) for w in packer.closed]
    assert min(used) > 97 and max(used) <= 100
    assert sum(used) + sum(len(p[2]) // 4 for w in packer.open.values() for p in w) == total


def test_packing_odd_tables(odd, empty, library):
    rows = packing.pack(odd, PATH).collect()
    want = sum(map(len, all_ids(library, odd.collect())))
    assert sum(r.length for r in rows) == want
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3, 4)] == [(1, 1)] * 3
    assert packing.pack(empty, PATH).count() == 0


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        p = materialise.Permutation(n, 7)
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert np.array_equal(p.number(slots), np.arange(n))
    a, b = (materialise.Permutation(1000, k).slot(np.arange(1000)) for k in (1, 2))
    assert (a == b).mean() < 0.02 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.1


def test_training_order_round_trip(spark, documents, byte_ids):
    folder = materialise.training_folder(spark)
    manifest = materialise.write_training_order(documents, *RANKS, folder, key=5, length=128, per_shard=100).orderBy("slot").collect()
    n = len(manifest)
    assert [r.slot for r in manifest] == list(range(n))
    records = list(materialise.read_slots(folder, 0, n + 9, 128))
    shards = [r.shard for r in manifest]
    assert len(records) == n and len(set(shards)) > 5 and shards == sorted(shards)
    first = {s: shards.index(s) for s in shards}
    for r, record in zip(manifest, records, strict=True):
        assert r.byte_offset == (r.slot - first[r.shard]) * 256
        assert crc32(record[: r.length].tobytes()) == r.ids_crc32 and (record[r.length :] == 50256).all()
    # Resumed anywhere, reading goes on with the same records.
    for r, record in zip(records[257:], materialise.read_slots(folder, 257, n, 128), strict=False):
        assert np.array_equal(r, record)
    assert len(list(materialise.read_slots(folder, 257, 31, 128))) == 31
    order = sorted(range(n), key=lambda k: manifest[k].number)
    assert abs(np.corrcoef(order, np.arange(n))[0, 1]) < 0.1
    stream = np.concatenate([records[k][: manifest[k].length] for k in order])
    assert np.array_equal(stream, np.concatenate(byte_ids(documents.collect())))
    ids = dict(zip([r.doc_id for r in documents.collect()], byte_ids(documents.collect()), strict=True))
    for r, record in zip(manifest, records, strict=True):
        part = ids[r.first_doc_id][r.first_start : r.first_start + r.length]
        assert len(part) and np.array_equal(record[: len(part)], part)


def test_training_order_query(spark, documents, byte_ids):
    rows = QUERIES["op7_training_order"](spark, SF).collect()
    total = sum(map(len, byte_ids(documents.collect())))
    assert sum(r.length for r in rows) == total and len(rows) == -(-total // 2048)


def test_training_order_odd_tables(spark, odd, empty, byte_ids):
    rows = materialise.write_training_order(odd.coalesce(1), *RANKS, materialise.training_folder(spark), length=64).collect()
    assert sum(r.length for r in rows) == sum(map(len, byte_ids(odd.collect())))
    assert materialise.write_training_order(empty, *RANKS, materialise.training_folder(spark)).count() == 0
