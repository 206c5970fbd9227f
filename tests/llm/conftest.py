import pytest

#: Nulls, empty and long texts, repeated rows, equal texts, columns whose names clash with those that operators make.
ODD = [
    (5, None, "a", 1),
    (1, "", "b", 2),
    (2, "the same text of some words, the same text of some words", "a", None),
    (3, "the same text of some words, the same text of some words", None, 3),
    (3, "the same text of some words, the same text of some words", None, 3),
    (7, "é ü 漢字 ​🙂 <|endoftext|> \n\n\t  x" * 3, "a", 1),
    (None, "a row without an id", "a", 1),
    (9, "ab" * 20_000 + " " * 500 + "%" * 700, "a", 1),
]
ODD_SCHEMA = "doc_id long, text string, shard string, n_tokens int"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
