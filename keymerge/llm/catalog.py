"""Queries of the text operators: each applies one operator to its whole table.

A query takes ``(spark, sf_dir)``; vocabularies are the public files that
``public_tokenizers`` names.  ``ORACLE`` has the SQL where the results can be
written in SQL; ``tests/llm`` holds the other queries against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, divergence, lattice, materialise, minhash, packing, pii, quality_model, quality_rules, secrets, sharding, wu_manber
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query
def op2_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text of ``documents``, learned from ``labels``."""
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``embeddings`` by cosine."""
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` by sets of two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                        with_ids=False).drop("ids")


@query
def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as token shards in a keyed order; the manifest of the shards."""
    return materialise.write_training_order(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                            public_tokenizers.PATTERN, materialise.training_folder(spark), key=2048)


@query
def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text of ``documents``, decode the ids, and digest both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(coded, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``: candidates and the forest's verdict."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text of ``documents`` and the verdict of the adaptive rules."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


@query
def op11_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` in every text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wu_manber.digest(wu_manber.find_passages(docs, table(spark, sf_dir, "benchmark")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op11_wu_manber"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, array_to_string(w[k:k + 9], ' ') AS phrase, least(len(w), 10) AS n
      FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS phrase
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))),
m AS (SELECT r, k, s.n, item FROM s JOIN p ON s.phrase = p.phrase AND s.n = p.n),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query
def op12_arrow_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language of ``documents``."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op12_arrow_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * v.v)::HUGEINT AS p
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)::HUGEINT) // (max(total) + 2 * max(v))::HUGEINT AS q
      FROM c JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
         ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 10
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``."""
    return collocations.mine(table(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = f"""
WITH s AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w)) AS n FROM s GROUP BY lang),
o AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM s, (SELECT unnest(range(1, 6)) AS m)),
f AS (SELECT lang, m, array_to_string(w[k:k + m - 1], ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
x AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
y AS (SELECT x.lang, x.phrase, x.a, x.k, p.f AS l, q.f AS r, t.n,
             (1000 * x.a::HUGEINT * t.n::HUGEINT) // (p.f::HUGEINT * q.f::HUGEINT) AS score
      FROM x JOIN t USING (lang) JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(x.w[1:x.k], ' ')
      JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(x.w[x.k + 1:x.m], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(w[b:b + j - 1], ' ') AS phrase FROM (
          SELECT lang, a, w, j, unnest(range(1, m - j + 2)) AS b FROM (SELECT lang, a, w, m, unnest(range(2, m)) AS j FROM c WHERE m > 2)))
      GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""
