import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, votes string, token long, key long, label string, digest string, payload string, size long, n long"
CLASH = (0.5, "x", 1, 2, "l", "d", "p", 3, 4)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ten", "su", "ré", "po"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def hard_rows():
    long = prose(99, 20_000)
    near = prose(5, 300)
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "  \n\t ", "en", "a"),
        (4, "one", "en", None),
        (5, "one two", "de", "b"),
        (6, near, "en", "a"),
        (7, near, "en", "b"),
        (8, near + " tail", "en", None),
        (8, near + " tail", "en", None),
        (None, near, "fr", "a"),
        (None, "no id here", None, "b"),
        (9, long, "en", "a"),
        (10, "x" * 50_000, "en", "b"),
        (11, "Licensed under the Apache License, Version 2.0.\nMIT license GNU General\nPublic License", "en", "a"),
        (12, "日本語 テキスト ｆｕｌｌ　width \U0001f642 <|endoftext|> <s>", "ja", "a"),
        (13, "a  b\r\nc d\x1ce ▁f", "en", "a"),
    ]
    return [(i, t, lang, source, len(t or ""), *CLASH) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
