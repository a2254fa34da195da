"""Tables with every awkward case at once, and a small slice of real ones."""

import random

import pytest

WORDS = [a + b for a in "ka lo mi nu re sa ti vo wu xe".split() for b in "ban del fir gos hum jat".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text): null and empty texts, white space, ties, repeated rows, a null id, one very long text, near copies."""
    rng = random.Random(7)
    base = " ".join(sentence(rng, 12) for _ in range(12))
    words = base.split()
    near = words.copy()
    near[40] = "changed"
    other = [sentence(rng, 15) for _ in range(4)]
    rows = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b"),
        (7, "one two three"),
        (8, "One  two\nthree"),
        (9, "\n".join(other)),
        (10, "\n".join([*other[:2], sentence(rng, 15)])),
        (11, " ".join(sentence(rng, 20) for _ in range(1500))),
        (12, "Größe ÄÖÜ ß é 漢字 " * 30),
        (13, "the the the"),
        (None, base),
        (14, "same text"),
        (14, "same text"),
        (15, "a" * 3000),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """With columns whose names clash with outputs."""
    rows = [(i, t, "x", 0.5, True, i) for i, t in messy_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, score double, kept boolean, component_id bigint")


@pytest.fixture(scope="session")
def no_rows(messy):
    return messy.limit(0)
