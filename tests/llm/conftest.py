import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, len long, sid long, n long, "
          "key long, cell long, score double, label long, `end` long, rank long, target double")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("w" + "".join(chr(97 + int(c)) for c in str(rng.randrange(vocabulary))) for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and blank texts, one very long text, ties, repeated rows and a null id."""
    base = prose(1, 120)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "en", "b"),
        (6, prose(2, 30_000, 5_000), "en", "c"), (7, "one two three", "en", "c"), (8, "ONE\ttwo\nthree", "fr", "c"), (9, base.replace("wb ", "xb "), None, "a"),
        (None, prose(3, 60), "en", None), (10, "a\nb\nb\n\nb é 中 #|", "de", ""), (11, prose(4, 40) + "\n" + prose(4, 40), "de", "b"), (12, prose(5, 1), "de", "d"),
    ]


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text, lang, source) rows -> documents with extra columns whose names clash with the operators' own."""
    def make(rows):
        full = [(*r, None if r[1] is None else len(r[1]), True, -1, -1, -1, -1, -1, -1, 0.5, -1, -1, -1, 0.0) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd(frame):
    return frame(odd_rows())


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
