"""From raw documents to packed token sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents`` (others pass through).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keymerge.llm import minhash, packing, quality_model, quality_rules, secrets
from keymerge.llm.common import small_side, stored, table, unclashed


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as good.

    Null and empty texts have the score of the bias alone; repeated rows are scored each; labels of
    other documents are ignored, and an empty table gives no rows.
    """
    return quality_model.keep_good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break none of the adaptive rules.

    Null and empty texts go (they have no words); null languages and sources are groups of their
    own; repeated rows stay or go together; an empty table gives no rows.
    """
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8).

    The document with the smallest id stays; of repeated rows of an id and text, one.  An id may
    come with several texts: only those that are copies go.  Rows without an id name no document
    that could be dropped, and stay.
    """
    found = stored(minhash.copies(docs), "verdicts")
    docs, restore = unclashed(docs, "doc_id", "text")
    key = ["doc_id", "_text_hash"]
    verdict = found.withColumnRenamed("text_hash", "_text_hash")
    dropped = small_side(stored(verdict.filter("not kept").select(*key), "dropped"))
    left = docs.withColumn("_text_hash", F.xxhash64("text")).join(dropped, key, "left_anti")
    again = small_side(stored(verdict.filter("kept and rows > 1").select(*key), "again"))
    if again.isEmpty():
        return restore(left)
    return restore(left.join(again, key, "left_semi").dropDuplicates(key).unionByName(left.join(again, key, "left_anti")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows the text."""
    docs, restore = unclashed(docs, "doc_id", "text", "lang", "source", "n_chars")
    masked = secrets.redact(docs.withColumn("length", F.length("text")), stored(secrets.scan(docs), "secrets"))
    longer = F.coalesce(F.length("text") - F.col("length"), F.lit(0))
    return restore(masked.withColumn("n_chars", F.col("n_chars") + longer))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, packed into sequences of at most 2048.

    A null or empty text gives the end token alone; repeated rows and rows without an id are packed
    each; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The classifier, the signatures and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
