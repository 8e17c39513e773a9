import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag int, key string, digest string, score double"


def passage(rng, words):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(words))


def edge_rows():
    """Nulls in every column, empty, blank, short and long texts, copies, near copies, repeated
    rows, rows without doc_id, and columns named like the operators' own."""
    rng = random.Random(4)
    shared, other = passage(rng, 60), passage(rng, 90)
    texts = {
        1: None, 2: "", 3: " \t\n\x0b ", 4: "a", 5: other, 6: other, 7: other.replace(" ", "\n  "), 9: passage(rng, 9000),
        10: passage(rng, 30) + " " + shared, 11: shared + "\n" + passage(rng, 40), 12: "x" * 700, 13: "ab " * 400,
        14: other[:-3] + "zz 🤦🏼‍♂️", 15: passage(rng, 34), 16: shared.upper(), 17: "line one two\nline one two\n\nline one two three ###",
    }
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", None) for i, t in texts.items()]
    rows += [(8, other + " end", "en", None, 3)] * 2 + [(None, other, None, "s", 1), (None, None, None, None, None), (10, "another text of document ten", "en", "s", 2)]
    return [(*r, 1, "k", None, 0.5) for r in rows]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
