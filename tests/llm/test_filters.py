"""The filter interaction audit against a plain version that applies every order."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from brute import LAST, WHITE
from pyspark.sql import functions as F

from graphloom.llm import filters

LABELS = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (4, 1, None), (4, None, 1), (29, 1, 1), (29, 0, 0), (None, 1, 1), (18, 1, 0), (999, 1, 1), (24, 0, 1)]


def plain_text_filters(text):
    words = WHITE.findall(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def plain(rows, labels, fails=plain_text_filters, names="ABCDE"):
    first = {}
    for doc_id, _, text in rows:
        first[text or ""] = min(first.get(text or "", LAST), LAST if doc_id is None else doc_id)
    docs = []
    for doc_id, part, text in rows:
        own = {n for n, bad in fails(text or "").items() if bad}
        if (LAST if doc_id is None else doc_id) > first[text or ""]:
            own.add(names[-1])
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and t == 1 for i, _, t in labels if i is not None)
        docs.append((part or "", own, good, toxic))
    out, shares = [], Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations(names):
            here = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in here if f in d[1]]
                here = [d for d in here if f not in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                alone = sum(d[1] == {f} for d in failing)
                shares[part, f] += len(gone)
                out.append((part, "".join(order), step, len(here), len(gone), len(failing) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return Counter((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def frames(spark, rows, labels=LABELS):
    docs = spark.createDataFrame([(i, p, t, "d", 1, True) for i, p, t in rows], "doc_id long, source string, text string, part string, mask int, known boolean")
    return docs, spark.createDataFrame([(*x, "d") for x in labels], "doc_id long, quality int, toxic int, d string")


@pytest.fixture(scope="session")
def mixed(rows):
    parts = ["web", "", None, "web", "books"]
    out = [(i, parts[n % 5], t) for n, (i, t) in enumerate(rows)]
    return [*out, (60, "web", "A# " * 250), (61, "web", "A# " * 250), (61, "books", "A# " * 250), (None, "x", "A# " * 250), (62, "x", " ".join(f"w{i}" for i in range(300))), (63, "ü", "Ab é中😀 " * 300)]


def test_every_order(spark, mixed):
    docs, labels = frames(spark, mixed)
    made = filters.audit(docs.repartition(5), labels)
    assert Counter(map(tuple, made.collect())) == plain(mixed, LABELS)
    assert [t for _, t in made.dtypes] == ["string", "string", "int", *["bigint"] * 7]


def test_other_filters_and_parts(spark, mixed):
    docs, labels = frames(spark, mixed)
    made = filters.audit(docs.withColumnRenamed("source", "host"), labels, {"L": F.length(F.coalesce("text", F.lit(""))) > 500, "X": F.coalesce("text", F.lit("")).contains("x")}, "E", "host")
    assert Counter(map(tuple, made.collect())) == plain(mixed, LABELS, lambda t: {"L": len(t) > 500, "X": "x" in t}, "LXE")


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, None), (1, None, ""), (2, "a", None), (None, "a", "")]
    docs, labels = frames(spark, rows, [])
    assert Counter(map(tuple, filters.audit(docs, labels).collect())) == plain(rows, [])
    assert filters.audit(*frames(spark, [], [])).collect() == []


def test_one_text_in_a_third_of_the_rows(spark):
    rows = [(i, f"s{i % 3}", "same $ text" if i % 3 else f"text {i}") for i in range(3000)]
    docs, labels = frames(spark, rows)
    assert Counter(map(tuple, filters.audit(docs, labels).collect())) == plain(rows, LABELS)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 1000, 4099])
def test_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert filters.positional_popcount(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_survival_words():
    words = filters.survival_words(5)
    assert all(bool(int(words[m]) >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))
