"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeats, extra columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, root long, key string, length int"


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(2, 6))) for _ in range(150)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(40))
    base = [draw.choice(vocabulary) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, "One TWO"), (5, "word"), (6, "x" * 3000), (7, " ".join(vocabulary * 40))]
    for k in range(8, n):
        kind = k % 6
        words = [draw.choice(vocabulary) for _ in range(draw.randint(3, 90))]
        if kind == 0:
            words = base[:]
        elif kind == 1:
            words = base[:]
            words[draw.randrange(len(words))] = "changed"
        elif kind == 2:
            words = words[:5] + passage.split() + words[5:]
        elif kind == 3:
            words = words[:5] + passage.split()[draw.randint(0, 27) :] + words
        rows.append((k, draw.choice([" ", "  ", "\n"]).join(words)))
    rows += [rows[12], rows[20], (None, "text without an id"), (200, " ".join(base))]
    return [(i, t, "en", "src", None, 0.5, True, 9, "k", 3) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
