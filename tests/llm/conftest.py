import pytest

LONG = " ".join(f"word{k % 997} the of and" for k in range(30_000))

ROWS = [
    (1, "The first text of the table is here and it is long enough to be a text. " * 6, "en"),
    (1, "The first text of the table is here and it is long enough to be a text. " * 6, "en"),
    (2, None, "en"), (3, "", None), (4, " \t\n ", "de"), (None, "A text without an id, and with some words in it.", None),
    (None, None, None), (5, LONG, "en"), (6, "\u0301\u4e2d\u6587 \U0001f600 idiot", "fr"), (6, "the same id with another text", "fr"),
]
# Names that operators use inside or for their results.
CLASHES = ["score", "host", "rank", "key", "node", "n", "at", "words", "shard", "copies", "label", "_body", "doc", "mark", "n_words", "lang_pred"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows and ids, clashing column names."""
    rows = [(*r, *[f"x{k}" for k in range(len(CLASHES))]) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
