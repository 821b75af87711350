import pytest

from keymerge.llm.common import table

SF = "/root/testdata/sf0.001"

#: Extra columns named like columns that the operators make or join on.
CLASHING = ("score", "ids", "node", "keys", "kept", "component_id", "shard", "size", "slot", "part", "start", "spans", "n_words", "length", "label", "place")


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    words = " ".join(f"word{i % 997}x{i}" for i in range(40_000))
    texts = [
        (1, "plain words in a row, nothing else"), (2, None), (3, ""), (4, " \t\n "), (5, words), (6, words + " end"),
        (7, "x" * 100_000), (8, "copy of a text that is there more than once"), (9, "copy of a text that is there more than once"),
        (9, "copy of a text that is there more than once"), (None, "copy of a text that is there more than once"), (None, None),
        (10, "mail a.b@c.org or +1 (555) 010-9999, card 4111 1111 1111 1111, ip 10.0.0.1; token = \"0123456789abcdef0123456789abcdef01234567\""),
        (11, "\u0130stanbul \u00df \u65e5\u672c\u8a9e \U0001f469\u200d\U0001f467 a\u0301\u3000b\x85c\x1cd"), (12, "one"), (13, "# * $ % & | < > " * 40),
    ]
    rows = [(i, t, None if k % 4 == 3 else "en", None if k % 5 == 4 else f"s{k % 2}", len(t) if t else None, *[k] * len(CLASHING)) for k, (i, t) in enumerate(texts)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
