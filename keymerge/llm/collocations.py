"""Phrases whose words keep together, by sorting pointers to suffixes.

A text is cut into pieces and words; a *suffix* is the words from one place on, up
to the longest phrase.  All suffixes with the same two leading words are routed to
one task, which sorts pointers to them by multikey three-way quicksort, one word at
a time: the size of the equal partition at a depth is the count of that phrase, and
partitions that hold too few suffixes are abandoned at once.

Before routing, suffixes that cannot belong to a frequent phrase are left out: a
phrase's words and pairs of neighbours are as frequent as itself.  Words and hashes
of pairs are counted first; the frequent ones go to the tasks as bit maps of bounded
size.  A bit map can only let too much through, so counts stay exact.  A task gives
equal suffixes of its own texts once, with their number.  Suffixes of a pair too
frequent for one task are dealt by all their words instead, sorted without
abandoning, and their counts added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import pick, prepare, small_side, stored

#: Text bytes worked on together; suffixes sorted together; suffixes of a pair that one task sorts; bits of a map.
TOGETHER, SORTED_ROWS, HOT, MOST_BITS = 8_000_000, 200_000, 2_000_000, 1 << 28

_BREAK = b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]], _CLASS[list(_BREAK)] = 1, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All words of the texts: codes, the words that the codes stand for, and the piece of each word."""
    raw = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    kind = _CLASS[raw]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = kind == 0
    begin, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    data = raw[word[1:-1]]
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin] if len(begin) else np.zeros(0, np.int32)
    return words.indices.to_numpy(zero_copy_only=False), words.dictionary, piece


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, of about ``TOGETHER`` bytes in all languages."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    seed = crc32(lang.encode())
    return np.array([xxh64_intdigest(w, seed) for w in words.to_pylist()], np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03) + (a >> np.uint64(7)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Bits:
    """A set of 64-bit hashes as a map of ``size`` bits (a power of two): no false misses."""

    size: int
    segments: dict[int, bytes]

    def map(self) -> np.ndarray:
        out = np.zeros(self.size // 8, np.uint8)
        for k, part in self.segments.items():
            out[k * 8192 : k * 8192 + len(part)] = np.frombuffer(part, np.uint8)
        return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bit_map(hashes: DataFrame) -> Bits:
    """The map of a column ``h``; its size follows the number of hashes, up to ``MOST_BITS``, and is built in parts."""
    size = 1 << 16
    rows = hashes.count()
    while size < 16 * rows and size < MOST_BITS:
        size *= 2

    def build(group: pa.Table) -> pa.Table:
        at = group["bit"].to_numpy()
        part = np.zeros(65536, bool)
        part[at & 65535] = True
        return pa.table({"segment": pa.array([at[0] >> 16], pa.int64()), "bits": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    bit = F.col("h").bitwiseAND(F.lit(size - 1))
    parts = (hashes.select(bit.alias("bit")).distinct().withColumn("segment", F.shiftright("bit", 16))
             .groupBy("segment").applyInArrow(build, "segment long, bits binary").toArrow().to_pydict())  # size / 8 bytes
    return Bits(size, dict(zip(parts["segment"], parts["bits"], strict=True)))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n``; without a word: the number of all."""
    for lang, texts in _chunks(batches):
        codes, words, _ = tokens(texts)
        n = np.bincount(codes, minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(words) + 1)), pa.concat_arrays([words.cast(pa.string()), pa.array([None], pa.string())]), pa.array(np.append(n, len(codes)))],
            ["lang", "word", "n"])


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = [xxh64_intdigest(w, crc32(lang.encode())) for lang, w in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([_signed(np.array(h, np.uint64))], ["h"])


def _pairs(lang: str, texts: list[bytes], frequent: np.ndarray):
    """Codes, words and their hashes, and for each word: whether it and the next are frequent and stand together."""
    codes, words, piece = tokens(texts)
    h = _hashes(lang, words)
    good = _has(frequent, h)[codes] if len(codes) else np.zeros(0, bool)
    return codes, words, h, good[:-1] & good[1:] & (piece[:-1] == piece[1:])


def _count_pairs(frequent):
    """``h, n``: hashes of pairs of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value.map()
        for lang, texts in _chunks(batches):
            codes, words, h, linked = _pairs(lang, texts, bits)
            at = np.flatnonzero(linked)
            pair, n = np.unique(codes[at].astype(np.int64) * len(words) + codes[at + 1], return_counts=True)
            if len(pair):
                yield pa.RecordBatch.from_arrays([_signed(_mix(h[pair // len(words)], h[pair % len(words)])), pa.array(n)], ["h", "n"])

    return run


def _give_suffixes(frequent, pairs, hot, longest: int):
    """``lang, route, whole, suffix, n``: the distinct suffixes of these texts that may hold a frequent phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pair_bits, hot_bits = frequent.value.map(), pairs.value.map(), hot.value.map()
        for lang, texts in _chunks(batches):
            codes, words, h, linked = _pairs(lang, texts, bits)
            at = np.flatnonzero(linked)
            linked[at] = _has(pair_bits, _mix(h[codes[at]], h[codes[at + 1]]))
            at = np.flatnonzero(linked)
            if not len(at):
                continue
            linked = np.append(linked, np.zeros(longest, bool))
            rows = np.full((len(at), longest), -1, np.int32)
            on = np.ones(len(at), bool)
            for k in range(longest):
                rows[on, k] = codes[at[on] + k]
                on = on & linked[at + k]
            key, first, n = rows[:, 0].astype(np.int64), None, None
            for k in range(1, longest):  # equal suffixes once
                _, key = np.unique(key, return_inverse=True)
                key = key * (len(words) + 1) + rows[:, k] + 1
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            rows = rows[first]
            route = _mix(h[rows[:, 0]], h[rows[:, 1]])
            whole = _has(hot_bits, route)
            if whole.any():
                some = rows[whole]
                r = route[whole]
                for k in range(2, longest):
                    r = _mix(r, np.where(some[:, k] >= 0, h[some[:, k]], np.uint64(k)))
                route[whole] = r
            columns = [words.take(pa.array(rows[:, k], mask=rows[:, k] < 0)) for k in range(longest)]
            text = pc.binary_join_element_wise(*columns, b" ", null_handling="skip").cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), _signed(route), pa.array(whole), text, pa.array(n)],
                                             ["lang", "route", "whole", "suffix", "n"])

    return run


def sort_suffixes(rows: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to ``rows`` (one word code a column, -1 beyond the end).

    Gives ``(row, words, count)`` of each prefix of two words or more, ``count`` being the weight of
    the rows that begin with it; partitions with less than ``least`` are abandoned.
    """
    todo = [(np.arange(len(rows)), 0)]
    while todo:
        pointers, depth = todo.pop()
        word = rows[pointers, depth]
        pivot = word[len(word) // 2]
        if pivot < 0:  # suffixes that end here: the greater ones go on
            sides = [word > pivot]
        else:
            equal = pointers[word == pivot]
            count = int(weight[equal].sum())
            if count >= least:
                if depth:
                    yield int(equal[0]), depth + 1, count
                if depth + 1 < rows.shape[1]:
                    todo.append((equal, depth + 1))
            sides = [word < pivot, word > pivot]
        for side in sides:
            part = pointers[side]
            if len(part) and weight[part].sum() >= least:
                todo.append((part, depth))


def _sort(least: int, longest: int):
    """``lang, phrase, n`` of suffixes that come sorted by route."""

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for lang in pc.unique(rows["lang"]).to_pylist():
            for whole in (False, True):
                some = rows.filter(pc.and_(pc.equal(rows["lang"], lang), pc.equal(rows["whole"], whole)))
                if not some.num_rows:
                    continue
                codes, words, suffix = tokens(some["suffix"].cast(pa.binary()).to_pylist())
                matrix = np.full((some.num_rows, longest), -1, np.int32)
                first = np.searchsorted(suffix, np.arange(some.num_rows))
                matrix[suffix, np.arange(len(codes)) - first[suffix]] = codes
                text = words.to_pylist()
                found = [(b" ".join([text[c] for c in matrix[p, :d]]), n) for p, d, n in sort_suffixes(matrix, some["n"].to_numpy(), 1 if whole else least)]
                if found:
                    phrase, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                                                     ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if held and size >= SORTED_ROWS:  # only between two routes
                same = pc.index(pc.not_equal(b.column(1), held[-1].column(1)[-1]), True).as_py()
                same = b.num_rows if same < 0 else same
                held.append(b.slice(0, same))
                if same < b.num_rows:
                    yield from block(pa.Table.from_batches(held))
                    held, size = [b.slice(same)], b.num_rows - same
                continue
            held.append(b)
            size += b.num_rows
        if held:
            yield from block(pa.Table.from_batches(held))

    return run


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables ``phrases (lang, phrase, words, f)``, ``words (lang, phrase, f)`` of at least ``least``
    occurrences, and ``totals (lang, n)`` of all words.

    Words are runs without blanks and tabs in the pieces between ``. , ; : ! ?`` and line breaks,
    A-Z lower-cased; phrases of 2 to ``longest`` words lie within a piece.  Null text counts as empty,
    null language as ``und``; repeated rows count each; other columns are ignored; texts are read whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, lang=lang_col, text=text_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
                    .filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    words = counts.filter(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), "f")
    totals = counts.filter(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    share = spark.sparkContext.broadcast  # bit maps: at most MOST_BITS / 8 bytes each
    frequent = share(_bit_map(words.mapInArrow(_hash_words, "h long")))
    pairs = stored(rows.mapInArrow(_count_pairs(frequent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "pairs")
    common, hot = share(_bit_map(pairs)), share(_bit_map(pairs.filter(F.col("n") > HOT)))
    suffixes = rows.mapInArrow(_give_suffixes(frequent, common, hot, longest), "lang string, route long, whole boolean, suffix string, n long")
    phrases = stored(suffixes.repartition("route").sortWithinPartitions("route").mapInArrow(_sort(least, longest), "lang string, phrase string, n long")
                     .groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
                     .withColumn("words", F.size(F.split("phrase", " "))), "phrases")
    return phrases, words, totals


def _run(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase and ``n`` all words of the language.  A cut into a first part with count
    ``l`` and a rest with count ``r`` scores ``floor(1000 a n / (l r))``; the lowest-scoring cut counts,
    of equal ones the first.  A phrase that a longer one of the same count contains is left out.  Ranks
    go by score, then ``a`` (both the highest first), then phrase in UTF-8 order.  What counts as
    a word, and nulls, is said at ``phrase_counts``; an empty table gives no rows.
    """
    phrases, words, totals = phrase_counts(docs, least, longest, lang_col, text_col)
    w, one = F.col("w"), F.lit(1)
    split = phrases.withColumn("w", F.split("phrase", " "))
    counts = small_side(stored(phrases.select("lang", "phrase", "f").unionByName(words), "counts"))
    cuts = (split.withColumn("k", F.explode(F.sequence(one, F.col("words") - 1)))
            .select("lang", "phrase", F.col("f").alias("a"), "k", _run(w, one, F.col("k")).alias("first"),
                    _run(w, F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")))
    cuts = (cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang"))
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("product", big["a"] * big["n"] * F.lit(1000).cast("decimal(4,0)")).withColumn("parts", big["l"] * big["r"])
    scored = (cuts.withColumn("score", F.expr("product div parts"))
              .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")))
    inside = (split.filter("words > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
              .withColumn("at", F.explode(F.sequence(one, F.col("words") - F.col("length") + 1)))
              .select("lang", _run(w, F.col("at"), F.col("length")).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (scored.join(inside, ["lang", "phrase"], "left").select("lang", "phrase", "cut.*", "longer")
            .filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
            .withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
