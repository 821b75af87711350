"""Quality rules with adaptive thresholds per language and source.

Per text: counts of words, symbols, repeated lines and repeated word windows.
Their ratios go into mergeable quantile sketches (fixed logarithmic bins with
counts, so sketches of any parts add up, in any order, to the same sketch),
one per language and source.  Each group's upper fence replaces a fixed
cut-off; documents join the fences of their group and are kept or rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare, small_side, stored, tidied, unclashed, with_columns

SYMBOLS = "#*$%&|<>"
#: Distinct words whose hashes a worker keeps.
CACHE_WORDS = 200_000
#: Ratio -> bounds of the slack, how far above the upper quartile of its group it may lie at least.  The repeat
#: rule's lie below the base rule's 0.5.
SLACK = {"symbol_ratio": (0.01, 0.03), "dup_line_ratio": (0.4, 0.45), "repeat_ratio": (0.35, 0.44), "mark_ratio": (0.03, 0.1), "upper_ratio": (0.2, 0.45)}
#: Fence: upper quartile + SPREAD * (upper - lower quartile), or + the slack if that is more: TAIL * (upper decile -
#: lower quartile), within its bounds.
SPREAD, TAIL = 4.0, 2.0
#: Groups of fewer documents use their language's sketch, and languages of fewer the whole corpus'.
MIN_GROUP = 100
#: Bins of the sketches: a ratio is known to within this factor; below SMALLEST it counts as 0.
GAMMA, SMALLEST = 1.02, 1e-4

_STATS = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
          "n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_upper long, n_letters long")
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS.encode())
_NOT_MARKS = bytes(c for c in range(256) if c not in b"!?")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"


class WordHashes:
    """64-bit hashes of words, kept for the words seen most recently."""

    def __init__(self, limit: int = CACHE_WORDS, seed: int = 0):
        self.known: dict[bytes, int] = {}
        self.limit, self.seed = limit, seed

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            seed = self.seed
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w, seed)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def repeat_words(h: np.ndarray, window: int = 3) -> int:
    """Words lying in a window of ``window`` words that occurs at least twice."""
    if len(h) <= window:
        return 0
    with np.errstate(over="ignore"):
        w = h[: len(h) - window + 1].copy()
        for k in range(1, window):
            w *= np.uint64(0x9E3779B97F4A7C15)
            w ^= w >> np.uint64(29)
            w += h[k : len(h) - window + 1 + k]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] = same
    twice[:-1] |= same
    covered = np.zeros(len(h), bool)
    at = order[twice]
    for k in range(window):
        covered[at + k] = True
    return int(covered.sum())


def text_stats(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _CONTINUATION)) - len(text) + len(text.translate(None, _SPACE))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (n, chars, len(text.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(hashes.of(words)), len(lines), len(text.translate(None, _NOT_MARKS)),
            len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _NOT_LETTERS)))


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        rows = [text_stats(t or b"", hashes) for t in b.column(3).cast(pa.binary()).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 9
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in cols)],
            ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "n_lines", "n_marks", "n_upper", "n_letters"])


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every whole text; a null text counts as empty."""
    prepare(docs.sparkSession)
    return pick(docs, doc_id=id_col, lang=lang_col, source=source_col, text=text_col).mapInArrow(tidied(_stat_batches), _STATS)


def _ratios() -> dict[str, Column]:
    def part(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {"symbol_ratio": part("n_symbols", "word_chars"), "dup_line_ratio": part("n_dup_lines", "n_lines"),
            "repeat_ratio": part("n_repeat_words", "n_words"), "mark_ratio": part("n_marks", "word_chars"),
            "upper_ratio": part("n_upper", "n_letters")}


def quantile_sketches(stats: DataFrame) -> DataFrame:
    """``(lang, source, metric, bin, n)``: a sketch is its bins' counts.  Adding the counts of
    two sketches bin by bin gives the sketch of both parts' rows."""
    metrics = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in _ratios().items()])
    bin_ = F.when(F.col("m.value") < SMALLEST, F.lit(None)).otherwise(F.ceil(F.log(GAMMA, F.col("m.value"))))
    return (stats.select("lang", "source", F.explode(metrics).alias("m"))
            .select("lang", "source", F.col("m.metric").alias("metric"), bin_.cast("int").alias("bin"))
            .groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n")))


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def _fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """``(keys, metric, n, fence)``; the windows hold a sketch's bins, not documents."""
    from pyspark.sql import Window

    least, most = (F.create_map(*[F.lit(x) for k, b in SLACK.items() for x in (k, b[i])])[F.col("metric")] for i in (0, 1))
    w = Window.partitionBy(*keys, "metric").orderBy(F.col("bin").asc_nulls_first())
    whole = Window.partitionBy(*keys, "metric")
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin")))
    s = sketches.withColumns({"value": value, "below": F.sum("n").over(w), "total": F.sum("n").over(whole)})

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("below") >= q * F.col("total"), F.col("value")))

    s = s.groupBy(*keys, "metric").agg(F.first("total").alias("n"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"), quantile(0.9).alias("q9"))
    slack = F.least(most, F.greatest(least, TAIL * (F.col("q9") - F.col("q1"))))
    return s.select(*keys, "metric", "n", (F.col("q3") + F.greatest(SPREAD * (F.col("q3") - F.col("q1")), slack)).alias("fence"))


def adaptive_fences(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with a fence for each ratio.

    A group of fewer than ``min_group`` documents takes the fence of its
    language's merged sketch, and a smaller language that of all documents.
    """
    cells = stored(quantile_sketches(stats), "sketches")
    by_lang = merge_sketches(cells, "lang")
    own = _fences(cells, "lang", "source")
    lang = _fences(by_lang, "lang").select(F.col("lang").alias("l"), F.col("metric").alias("lm"), F.col("n").alias("ln"), F.col("fence").alias("lf"))
    every = _fences(merge_sketches(by_lang)).select(F.col("metric").alias("em"), F.col("fence").alias("ef"))
    j = (own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("lm")))
         .join(every, F.col("metric") == F.col("em")))
    fence = F.when(F.col("n") >= min_group, F.col("fence")).when(F.col("ln") >= min_group, F.col("lf")).otherwise(F.col("ef"))
    return j.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, fence)).alias(f"max_{k}") for k in SLACK])


def _judged(stats: DataFrame, fences: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """``stats`` with ``base_failed``, ``broken`` and ``kept``, by the fences of each row's group."""
    f = fences.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[f"max_{k}" for k in SLACK])
    broke = F.array(*[F.when(v > F.col(f"max_{k}"), F.lit(k)) for k, v in _ratios().items()])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (stats.join(f, F.col(lang_col).eqNullSafe(F.col("_l")) & F.col(source_col).eqNullSafe(F.col("_s")), "left")
            .withColumns({"base_failed": base, "broken": F.array_compact(broke)})
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)))


def apply_rules(docs: DataFrame, min_group: int = MIN_GROUP, **cols: str) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the rules that a text broke, one row per row of ``docs``.

    * A null or empty text has no words: all counts are 0, it fails the base rule.
    * A null ``lang`` or ``source`` is a group of its own.
    * Repeated rows each get a row; an empty table gives no rows; other columns are ignored.
    * Texts are read whole, at any length.
    """
    stats = stored(document_stats(docs, **cols), "stats")
    fences = small_side(stored(adaptive_fences(stats, min_group), "fences"))
    return (_judged(stats, fences, "lang", "source")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    F.concat_ws(",", "broken").alias("broken")))


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id, text, lang, source`` and any others) that break no rule.

    The counts are taken twice, for the sketches and beside the rows: that spares a
    shuffle of all texts.  A null or empty text has no words and goes; a null ``lang`` or
    ``source`` is a group of its own, and rows without an id are judged like all others; repeated
    rows count and stay each; an empty table gives no rows.
    """
    docs, restore = unclashed(docs, "doc_id", "text", "lang", "source")
    fences = small_side(stored(adaptive_fences(stored(document_stats(docs), "stats"), min_group), "fences"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters")

    def make():
        hashes = WordHashes()

        def stats(texts: list[bytes]) -> list[pa.Array]:
            rows = [text_stats(t, hashes) for t in texts]
            return [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))]

        return stats

    counted = with_columns(docs, "text", ", ".join(f"{n} long" for n in names), make)
    return restore(_judged(counted, fences, "lang", "source").filter("kept"))
