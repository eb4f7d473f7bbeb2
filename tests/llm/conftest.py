import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string"


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text); columns with names that the operators use inside are there, too."""

    def make(rows, source="s", lang="en"):
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), "clash", "clash") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    r = random.Random(8)
    letters = {"en": "the and ing er th on re ou", "de": "sch ein ung ü ß der ge ich", "ru": "ов ая не при ст ени"}

    def make(lang, n):
        parts = letters[lang].split()
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))

    return make
