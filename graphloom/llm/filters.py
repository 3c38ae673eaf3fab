"""How the filters of a cleaning step interact, for every order in which they could be applied.

With ``n`` filters a document survives a subset of them if it fails none of its members. Its 32-bit word has
bit ``S`` set for each survived subset ``S``, so one word holds the document's row of the truth table. The words of
a part are added up position by position: carry-save adders turn three words into a sum and a carry word, and
only the few words left at each weight are taken apart into bits. The counts of survivors per subset answer
every question about an order: what a step keeps is the count of the subset before and after it.

Filters look at one document each, as a column that is true where the document fails; the last one is "identical
text under a smaller id", found by the smallest id of each text digest (SHA-256) and a join on digest and id, so a
text with many copies is no hot key.

Defined results: a null text counts as an empty one; a null part as an empty string; a null ``doc_id`` is larger than any
other and has no labels; rows of one id and one text do not make each other duplicates, and each counts; a document with
several label rows has a label if one of them says so; a part is reported in full, zeros included; an empty
table has no parts; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import column_of
from graphloom.session import cut, spread

LAST = 2**63 - 1
#: Parts that a task counts before it hands their counts on.
PARTS = 4096
CLASSES = ("all", "good", "toxic")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def text_filters(text: Column) -> dict[str, Column]:
    """The production filters on one text: true where it fails."""
    words = _words(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit, by carry-save addition of words of one weight."""
    bits = np.arange(32, dtype=np.uint32)
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        counts += weight * ((words[:, None] >> bits) & 1).sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], weight * 2
    return counts


def survival_words(n: int) -> np.ndarray:
    """The word of each mask of failed filters."""
    mask, subset = np.arange(1 << n)[:, None], np.arange(1 << n)[None, :]
    return ((mask & subset) == 0).astype(np.uint64).dot(np.uint64(1) << np.arange(1 << n, dtype=np.uint64)).astype(np.uint32)


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str) -> DataFrame:
    """``(part, mask, good, toxic)`` per row of ``docs``; ``mask`` has a bit per filter, the copies' bit last."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))
    own = spread(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.col("doc_id").isNotNull().alias("known"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    own = cut(own)
    first = own.groupBy("digest").agg(F.min("d").alias("d")).withColumn("first", F.lit(True))
    good, toxic = F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    labelled = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("d")).agg(good, toxic).withColumn("known", F.lit(True))
    joined = own.join(first, ["digest", "d"], "left").join(labelled, ["d", "known"], "left")
    copy = F.when(F.col("first").isNull(), F.lit(1 << len(filters))).otherwise(F.lit(0))
    return joined.select("part", (F.col("mask") + copy).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in CLASSES[1:]])


def survivors(failed: DataFrame, n: int) -> DataFrame:
    """``(part, all, good, toxic)``: per part and class an array of the documents that survive each subset of ``n`` filters."""
    size = 1 << n
    if size > 32:
        raise ValueError("a word holds the subsets of five filters at most")
    names = [f"{c}_{s}" for c in CLASSES for s in range(size)]
    table = survival_words(n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def made() -> pa.RecordBatch:
            columns = np.stack(list(counts.values()), axis=1).reshape(len(names), -1)
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *map(pa.array, columns)], ["part", *names])

        for batch in batches:
            coded = column_of(batch, "part").dictionary_encode()
            index = coded.indices.to_numpy()
            words = table[column_of(batch, "mask").to_numpy()]
            classes = [None, *(column_of(batch, c).to_numpy(zero_copy_only=False) for c in CLASSES[1:])]
            order = np.argsort(index, kind="stable")
            bounds = np.searchsorted(index[order], np.arange(len(coded.dictionary) + 1))
            for i, part in enumerate(coded.dictionary.to_pylist()):
                rows = order[bounds[i] : bounds[i + 1]]
                own = [positional_popcount(words[rows if c is None else rows[c[rows]]])[:size] for c in classes]
                counts[part] = counts.get(part, 0) + np.stack(own).reshape(-1)
            if len(counts) >= PARTS:
                yield made()
                counts.clear()
        if counts:
            yield made()

    schema = "part string, " + ", ".join(f"{x} long" for x in names)
    sums = failed.mapInArrow(count, schema).groupBy("part").agg(*[F.sum(x).alias(x) for x in names])
    return sums.select("part", *[F.array(*[f"{c}_{s}" for s in range(size)]).alias(c) for c in CLASSES])


def _steps(names: list[str]) -> Column:
    """All steps of all orders, each with the subset before it and its filter's bit."""
    rows = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order):
            rows.append({"filter_order": "".join(names[j] for j in order), "step": step + 1, "filter": i, "before": before, "bit": 1 << i})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order string, step int, filter int, before int, bit int>>")


def _shapley(n: int, i: int) -> Column:
    """What filter ``i`` removes, summed over all orders: a weighted sum of the counts of survivors."""
    weights = [0] * (1 << n)
    for subset in range(1 << n):
        if not subset >> i & 1:
            ways = math.factorial(subset.bit_count()) * math.factorial(n - 1 - subset.bit_count())
            weights[subset] += ways
            weights[subset | 1 << i] -= ways
    return F.aggregate(F.zip_with(F.col("all"), F.lit(weights), lambda x, w: x * w), F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with what the step keeps, removes and loses.

    ``filters`` maps up to four names to columns over ``text`` that are true where a document fails; ``copies`` names
    the filter of identical texts under a smaller id.
    """
    if filters is None:
        filters = text_filters(F.coalesce(F.col("text").cast("string"), F.lit("")))
    names = [*filters, copies]
    n, full = len(names), (1 << len(names)) - 1
    counted = survivors(failures(docs, labels, filters, part), n)
    counted = counted.withColumn("shares", F.array(*[_shapley(n, i) for i in range(n)]))
    rows = counted.select("part", *CLASSES, "shares", F.explode(_steps(names)).alias("s")).select("part", *CLASSES, "shares", "s.*")
    at = lambda c, subset: F.get(F.col(c), subset)
    after, others = F.col("before") + F.col("bit"), F.lit(full) - F.col("bit")
    removed = at("all", F.col("before")) - at("all", after)
    return rows.select(
        "part", "filter_order", "step",
        at("all", after).alias("kept"),
        removed.alias("removed"),
        (at("all", F.lit(0)) - at("all", F.col("bit")) - removed).alias("redundant"),
        (at("all", others) - at("all", F.lit(full))).alias("unique_fails"),
        (at("good", F.col("before")) - at("good", after)).alias("good_lost"),
        (at("toxic", F.col("before")) - at("toxic", after)).alias("toxic_lost"),
        F.get(F.col("shares"), F.col("filter")).alias("shapley"),
    )
