"""Near duplicates among embeddings against brute force."""

import math

import numpy as np
import pytest

from graphloom.llm import pivots
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, copies string, v string, list int, prefix int, root int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "c", "v", 3, 4, 5) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    """``{vec_id: (n_links, component_id, kept)}``, and the linked pairs of different vectors."""
    own = {}
    for i, v in rows:
        good = v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v) and any(np.float32(c) != 0 for c in v)
        w = tuple(float(np.float32(c)) for c in v) if good else None
        if i is not None and (i not in own or own[i] is None or (w is not None and w < own[i])):
            own[i] = w
    ids = sorted(own)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n, pairs = dict.fromkeys(ids, 0), []
    for length in {len(v) for v in own.values() if v}:
        some = [i for i in ids if own[i] and len(own[i]) == length]
        x = np.array([own[i] for i in some])
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            i, j = some[a], some[b]
            n[i], n[j] = n[i] + 1, n[j] + 1
            pairs.append((i, j))
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {i: (n[i], find(i), find(i) == i) for i in ids}, pairs


def result(spark, rows, **options):
    made = pivots.near_duplicates(frame(spark, rows), **options).collect()
    assert len({r.vec_id for r in made}) == len(made)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in made}


def clusters(rng, centres, size, noise, width=64):
    x = rng.normal(size=(centres, 1, width)) + noise * rng.normal(size=(centres, size, width))
    return x.reshape(-1, width)


ODD = [
    (1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] + [1.0] * 63), (1004, [float("inf")] * 64), (1005, [None] + [1.0] * 63),
    (None, [1.0] * 64), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1.0]), (1009, [-1.0]), (1010, [1e30] * 64), (1011, [1e-30] * 64), (1012, [1.0] * 64),
    (1013, [3.0, 1.0] * 32), (1013, [1.0] * 64), (1013, [1.0] * 64), (1014, None), (1014, [1.0] * 64),
]


@pytest.mark.parametrize("block", [4096, 7])
def test_groups_and_odd_vectors(spark, block):
    rng = np.random.default_rng(2)
    x = clusters(rng, 12, 9, 0.08)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(200 + i, list(map(float, x[0]))) for i in range(30)] + ODD
    want, _ = brute(rows)
    assert result(spark, rows, block=block) == want
    assert want[0][0] > 30 and want[1012][0] >= 3


def test_recall_near_the_threshold(spark):
    """Pairs at a cosine just above the threshold, where the prefixes differ the most."""
    rng = np.random.default_rng(3)
    x = pivots.unit(rng.normal(size=(3000, 64)))
    other = rng.normal(size=x.shape)
    other = pivots.unit(other - (other * x).sum(axis=1, keepdims=True) * x)
    cosine = rng.uniform(0.951, 0.965, size=(len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * other
    rows = [(i, list(map(float, v))) for i, v in enumerate(np.concatenate([x, y]))]
    want, pairs = brute(rows)
    made = result(spark, rows)
    assert all(made[i][0] <= want[i][0] for i in want)
    recall = sum(n for n, _, _ in made.values()) / (2 * len(pairs))
    print("recall", recall)
    assert recall >= 0.95


def test_many_near_copies_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, list(map(float, v))) for i, v in enumerate(np.concatenate([clusters(rng, 1, 700, 0.06), rng.normal(size=(500, 64))]))]
    want, _ = brute(rows)
    assert result(spark, rows, block=100) == want


def test_empty_and_unusable(spark):
    assert result(spark, []) == {}
    assert result(spark, [(5, None), (6, [0.0]), (None, None)]) == {5: (0, 5, True), 6: (0, 6, True)}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, _ = brute(rows)
    made = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op11_pivot_permutation_near_dedup"](spark, SF).collect()}
    assert made == want


@pytest.mark.parametrize("folder", ["/root/testdata/check_s", "/root/testdata/check_h"])
def test_recall_on_larger_tables(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, pairs = brute(rows)
    made = {r.vec_id: r for r in pivots.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet")).collect()}
    assert all(made[i].n_links <= want[i][0] for i in want) and len(made) == len(want)
    assert sum(r.n_links for r in made.values()) >= 0.9 * 2 * len(pairs)
