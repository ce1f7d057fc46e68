import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = "the of and in re tion ing er on an then that with for was édé île über straße niño".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, symbol-only, huge, tied and repeated texts."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 30) for _ in range(700))
    return [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, "!!! ??? ...", None, "s", 11),
        (5, prose(rng, 40), "en", "s", None),
        (6, long, "fr", "s", len(long)),
        (7, long, "fr", None, len(long)),
        (8, "Ein Wort", "de", "s", 8),
        (8, "Ein Wort", "de", "s", 8),
        (None, "no id at all here", "en", "s", 17),
        (9, "\x00  KK \U0001f600 ok", "en", "s", 9),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(df):
    """The table with extra columns named as operators name their own."""
    from pyspark.sql import functions as F

    names = ("id", "body", "words", "row", "hits", "items", "score", "kept", "label", "hash", "pos", "piece", "length", "doc")
    return df.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def clashing(odd):
    return with_clashes(odd)
