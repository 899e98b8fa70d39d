import os

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")

#: Null and empty texts, white space alone, ties, repeated rows, a null id, a long text, letters beyond ASCII.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, "one two three four", "en", None, 18),
    (5, "one two  three four", "en", "b", 19), (5, "one two  three four", "en", "b", 19), (6, "onetwothreefour", "en", "b", 15),
    (None, "a text without an id", "en", "b", None), (7, "straße ünïcode 中文 <|endoftext|> it's", "de", "c", 1),
    (8, "word " * 30_000, "en", "c", 150_000), (9, "x", "en", "c", 1), (10, "x", "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns whose names the operators use inside."""
    names = ["digest", "fp", "key", "class", "rank", "count", "n", "root", "keep_id", "length", "words", "label", "features", "score", "bucket", "block", "sequence_id", "h", "kept", "items", "spans", "n_words", "n_hit", "text_digest", "shorter", "best"]
    return odd.selectExpr("*", *[f"'junk' AS `{n}`" for n in names])
