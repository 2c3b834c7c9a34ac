import os
import random

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " * 400),
    (5, "One of two rows that are alike, word for word, in every column of this table."),
    (5, "One of two rows that are alike, word for word, in every column of this table."),
    (6, "One of two rows that are alike, word for word, in every column of this table."),
    (None, "A row without an id still has a text that counts as any other text does here."),
    (7, "naïve café — “quoted” don't we'll I'D 123 4½ ́漢字😀 <|endoftext|> end\r\n\x1c\x85."),
    (8, "x" * 5000),
    (9, "..."),
]
#: Columns that an operator might use inside.
CLASHING = ["fp", "ids", "spans", "_spans", "_spans_of", "_bad_id", "_kept_id", "n_words", "start", "digest", "component_id", "vslot", "salt", "key", "x"]


@pytest.fixture(scope="session")
def edge(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, "en", "s", None if t is None else len(t), *["z"] * len(CLASHING)) for i, t in EDGE]
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("false")


@pytest.fixture(scope="session")
def odd_texts():
    rnd = random.Random(5)
    parts = ["a", "b", "Z", "é", "ñ", " ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "'", "'s", "'re", "'ll", "'x", "1", "²", "½", "!", ".", "…", "😀", "́", "漢", "<|endoftext|>", "\r\n", "ß", "İ", "Σ", "\x85", "don't", "ǅ"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    return [*made, "", "a" * 700, " " * 90, "'" * 90, "ab" * 900, "aaaa" * 9]
