import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeats, copies and odd characters."""
    rnd = random.Random(5)
    prose = lambda n: " ".join(rnd.choices(WORDS, k=n))
    base, passage = prose(120), prose(60)
    rows = [
        (1, base, "en", "b", 1),
        (2, base, "en", "b", 1),
        (2, base, "en", "b", 1),
        (3, prose(30) + "\n" + passage + "\n" + prose(30), "en", "a", 1),
        (4, prose(20) + " " + passage + " " + prose(10), None, "a", None),
        (5, None, "fr", "a", 0),
        (6, "", "fr", None, 0),
        (7, " \n\t ", "fr", None, 0),
        (8, "é" * 300 + " été " + "é" * 300, "fr", "c", 1),
        (9, "a" * 1500, None, None, 1),
        (10, " ".join(prose(9) for _ in range(1500)), "en", "b", 1),
        (None, base + " x", "en", "b", 1),
        (None, None, None, None, None),
        (11, "one TWO three", "de", "c", 1),
        (12, "12 34 !! ##", "de", "c", 1),
        (13, base.replace("alpha", "alfa", 1), "en", "b", 1),
        (14, "x<|endoftext|>y  \n\n z's \U0001f600 日本語", "ja", "d", 1),
        (15, (prose(8) + "\n") * 40, "en", "a", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
