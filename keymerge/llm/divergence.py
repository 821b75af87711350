"""How far the sources of a language differ in their terms, by columnar counts.

Each task runs Arrow's compute functions over its texts (``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode``, hash ``group_by``) and gives out
partial counts per language, source and term.  Spark adds them up and keeps the
terms that enough documents have.  The kept counts are dealt out by term into
columnar shards; every shard gets the list of groups beside its terms, fills
the zero counts in, and sums the divergences of its terms exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, prepare, stored, tidied, tidy

#: Between terms: all ASCII but letters.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Text bytes counted together, counted rows a task holds, cells of a block, and sources up to which pair sums are held.
TOGETHER, HELD_ROWS, CELLS, HELD_SOURCES = 2_000_000, 250_000, 500_000, 2_000
#: Parts that a probability of 1 has.
SCALE = 1_000_000_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def count_terms(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """Per language, source and term of these documents: ``n`` occurrences in ``d`` documents."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), _BETWEEN)
    rows, terms = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(pc.binary_length(terms), 0)
    coded = terms.filter(real).dictionary_encode()
    words = pa.table({"row": rows.filter(real).cast(pa.int32()), "term": coded.indices})
    by_row = words.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    grouped = pa.table({"lang": lang.indices.take(by_row["row"].combine_chunks()), "source": source.indices.take(by_row["row"].combine_chunks()),
                        "term": by_row["term"], "n": by_row["count_all"]}).group_by(
        ["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table([lang.dictionary.take(grouped["lang"].combine_chunks()), source.dictionary.take(grouped["source"].combine_chunks()),
                     coded.dictionary.take(grouped["term"].combine_chunks()), grouped["n_sum"].cast(pa.int64()), grouped["count_all"].cast(pa.int64())],
                    schema=_COUNTS)


def _merge(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("d", "sum")])
    return t.rename_columns(["lang", "source", "term", "n", "d"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, merged as far as ``HELD_ROWS`` rows hold them."""
    waiting, size, held, rows = [], 0, [], 0

    def counted() -> pa.Table:
        t = pa.Table.from_batches(waiting).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns]
        return count_terms(*columns)

    for b in batches:
        waiting.append(b)
        size += b.column(2).nbytes
        if size < TOGETHER:
            continue
        held.append(counted())
        rows += held[-1].num_rows
        waiting, size = [], 0
        if rows > HELD_ROWS:
            held = [_merge(held)]
            rows = held[0].num_rows
            if rows > HELD_ROWS // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held, rows = [], 0
            tidy()
    if waiting:
        held.append(counted())
    if held:
        yield from _merge(held).to_batches(max_chunksize=50_000)


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * count / total)``, exact: long division by thousands, as the product may pass 64 bits."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class _Language:
    """Sums of one language in one shard."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], terms: int, top: int):
        self.lang, self.sources, self.top = lang, sources, top
        self.at = {s: k for k, s in enumerate(sources)}
        self.totals = np.array(totals, np.int64) + 2 * terms
        self.total = int(sum(totals)) + 2 * terms
        held = len(sources) <= HELD_SOURCES
        self.sums = np.zeros((len(sources), len(sources)), np.int64) if held else None
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]
        self.waiting: list[tuple[str, str, int]] = []

    def block(self, rows: list[tuple[str, str, int]]) -> Iterator[tuple]:
        """Add the terms of ``rows`` (whole terms, one after another)."""
        terms: list[str] = []
        where = np.empty((len(rows), 2), np.int64)
        for k, (term, source, _) in enumerate(rows):
            if not terms or terms[-1] != term:
                terms.append(term)
            where[k] = len(terms) - 1, self.at[source]
        count = np.zeros((len(terms), len(self.sources)), np.int64)
        count[where[:, 0], where[:, 1]] = [n for _, _, n in rows]
        p = _share(count + 2, self.totals)
        for a in range(len(self.sources) - 1):
            sums = _distance(p[:, a, None], p[:, a + 1 :]).sum(axis=0)
            if self.sums is not None:
                self.sums[a, a + 1 :] += sums
            else:
                yield from ((self.lang, self.sources[a], "pair", s, v) for s, v in zip(self.sources[a + 1 :], sums.tolist(), strict=True))
        q = _share(count.sum(axis=1) + 2, np.int64(self.total))
        value = np.where((count > 0) & (p > q[:, None]), _distance(p, q[:, None]), -1)
        for a in range(len(self.sources)):
            v = value[:, a]
            least = -1 if len(v) <= self.top else np.partition(v, len(v) - self.top)[len(v) - self.top]
            found = [(int(v[k]), terms[k]) for k in np.flatnonzero((v >= least) & (v >= 0))]
            self.best[a] = sorted(self.best[a] + found, key=lambda x: (-x[0], x[1]))[: self.top]

    def add(self, rows: list[tuple[str, str, int]]) -> Iterator[tuple]:
        """Take rows sorted by term; blocks end between two terms."""
        self.waiting += rows
        room = max(1, CELLS // len(self.sources))  # rows are at least as many as terms
        while len(self.waiting) > room:
            cut = room
            while cut < len(self.waiting) and self.waiting[cut][0] == self.waiting[cut - 1][0]:
                cut += 1
            if cut == len(self.waiting):
                return  # its last term may go on
            yield from self.block(self.waiting[:cut])
            self.waiting = self.waiting[cut:]

    def close(self) -> Iterator[tuple]:
        if self.waiting:
            yield from self.block(self.waiting)
        if self.sums is not None:
            for a, s in enumerate(self.sources):
                yield from ((self.lang, s, "pair", t, v) for t, v in zip(self.sources[a + 1 :], self.sums[a, a + 1 :].tolist(), strict=True))
        for s, best in zip(self.sources, self.best, strict=True):
            yield from ((self.lang, s, "term", t, v) for v, t in best)


_RESULT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _shard(top: int):
    """Per language its groups (rows without a term) and then its terms in order; gives partial sums and the best terms."""

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lang, groups, state = None, [], None
        for b in batches:
            langs, terms, sources, n, v = (b.column(k).to_pylist() for k in ("lang", "term", "source", "n", "v"))
            k = 0
            while k < len(langs):
                if langs[k] != lang:
                    if state:
                        yield from state.close()
                    lang, groups, state = langs[k], [], None
                if terms[k] is None:
                    groups.append((sources[k], n[k], v[k]))
                    k += 1
                    continue
                if state is None:
                    state = _Language(lang, [g[0] for g in groups], [g[1] for g in groups], groups[0][2], top)
                end = k
                while end < len(langs) and langs[end] == lang:
                    end += 1
                yield from state.add(list(zip(terms[k:end], sources[k:end], n[k:end], strict=True)))
                k = end
        if state:
            yield from state.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in results(batches):
            out.append(row)
            if len(out) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return run


def term_counts(docs: DataFrame, least_docs: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, term, source, n, first``: occurrences of each kept term, a row for each source that has it.

    A term is a run of characters other than ASCII non-letters, A-Z lower-cased; a language keeps the
    terms that at least ``least_docs`` of its documents have.  ``first`` marks one row of each term.
    Null text, language and source count as ''; repeated rows count each; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, lang=lang_col, source=source_col, text=text_col).na.fill("")
    term = Window.partitionBy("lang", "term")
    return (rows.mapInArrow(tidied(_partial), "lang string, source string, term string, n long, d long")
            .repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
            .withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
            .withColumn("docs", F.sum("d").over(term)).filter(F.col("docs") >= least_docs)
            .select("lang", "term", "source", "n", "first"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """Divergences between the sources of each language: ``lang, source, part, item, value, rank``.

    ``N`` is the number of kept terms' occurrences in a group (language and source) and ``V`` the
    number of the language's kept terms; a term's share is ``p = 1 + floor(10^9 (n + 2) / (N + 2 V))``,
    and two shares differ by ``f = floor((p - q)^2 / (p + q))``.  Part ``pair`` has each other source
    of the language with the sum of ``f`` over all kept terms (0 without any); part ``term`` the
    ``top`` kept terms of the group whose share is above the language's, by ``f`` between the two.
    Ranks go by value, the highest first, then by item in UTF-8 order.

    Every group of ``docs`` is in the result's pairs, also without terms or texts; a language with one
    source has no pairs.  Null text, language and source count as ''; an empty table gives no rows.
    The list of groups goes to each shard (the result has a row for each pair of them).
    """
    spark = docs.sparkSession
    counts = stored(term_counts(docs, least_docs, lang_col, source_col, text_col), "term_counts")
    terms = counts.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = stored(pick(docs, lang=lang_col, source=source_col).na.fill("").distinct()
                    .join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["n", "v"]), "groups")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    header = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", F.lit(None).cast("string").alias("term"), "source", "n", "v")
    dealt = header.unionByName(counts.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "term", "source", "n",
                                             F.lit(None).cast("long").alias("v")))
    sums = stored(dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("lang", "term", "source")
                  .mapInArrow(_shard(top), "lang string, source string, part string, item string, value long"), "shares")
    half = sums.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = (groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
             .join(both, ["lang", "source", "item"], "left").na.fill(0, ["value"]).withColumn("part", F.lit("pair")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = sums.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
