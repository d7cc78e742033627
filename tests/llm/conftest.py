import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_words import words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, f string, h string, row string, whole string, start string, total string, predicted string, key string"
CLASH = ("s", "s", "f", "h", "r", "w", "t", "t", "p", "k")


#: Null key, null and blank texts, one word, repeated rows, equal texts, a very long text and a very long word.
EDGES = [(None, "no key"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "the same text as others"), (5, "the same text as others"), (6, "the same text as others"), (7, words(7, 20_000)), (8, "x" * 9000), (9, "é漢🙂 ▁\x00 ok"), (10, None)]


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents, with more columns whose names operators use inside."""

    def make(rows, langs=None):
        return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), None if i is None or i % 4 == 1 else f"s{i % 3}", None if t is None else len(t), *CLASH) for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def edges(docs):
    return docs(EDGES)


@pytest.fixture(scope="session")
def none(docs):
    return docs([])
