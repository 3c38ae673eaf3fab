import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, h string, k int, name string, cell double"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def messy_rows():
    """Ids and texts with nulls, empty and very long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(5)
    passage, other = words(rng, 70), words(rng, 55)
    base = words(rng, 120)
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base[:60], "x", *base[60:]])), (3, " ".join(base[:100]))]
    rows += [(i, " ".join(words(rng, 40) + passage + words(rng, 30))) for i in range(4, 12)]
    rows += [(i, " ".join(words(rng, rng.randrange(30)) + other + words(rng, 10))) for i in range(12, 18)]
    rows += [(18, None), (19, ""), (20, " \t\n "), (21, "one two"), (22, "One  TWO"), (23, "alone"), (24, "x " * 150), (25, "x " * 60), (26, "a b " * 90), (27, "é ñ. 中文 — " * 20)]
    rows += [(28, " ".join(words(rng, 12_000) + passage)), (29, " ".join(passage + other)), (29, " ".join(passage + other)), (None, " ".join(passage)), (None, None), (None, " ".join(words(rng, 60)))]
    rows += [(30, " ".join(passage[:49])), (31, " ".join(passage[:50])), (32, "x\x00y " * 70), (33, " ".join(base).upper()), (34, "¿…? " * 3), (35, "42 !!")]
    rows += [(50, " ".join(words(rng, 5) + passage[2:68] + words(rng, 9) + passage[2:68] + words(rng, 9) + passage[2:68]))]
    near = words(rng, 200)
    for i in range(36, 46):
        copy = list(near)
        for _ in range(i - 35):
            copy[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    langs = ["en", "de", None]
    return spark.createDataFrame([(i, t, langs[n % 3], "s", len(t or ""), "d", "h", 1, "n", 0.5) for n, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
