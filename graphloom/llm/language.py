"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of the byte n-grams inside its words (with marks at both ends),
hashed into ``BUCKETS`` buckets; a linear layer and a softmax give the language. Embeddings and layer are
trained together by stochastic gradient descent in numpy, on at most ``PER_LANGUAGE`` texts of each
language (those with the smallest hash of their id). A fifth of these is left out of the training; on it a
temperature is fitted, and the score below which a prediction is rejected (``accepted`` is false), so
that accepted ones reach ``PRECISION``. As embedding and layer are linear, tasks hold only the logits of each
bucket.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text when there is
nothing to learn from; ties go to the language that sorts first; repeated rows get equal results; a null
``doc_id`` is not held out and not learned from; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.subwords import DistinctWords
from graphloom.llm.tokens import column_of, mix, slices

BUCKETS = 1 << 13
WIDTH = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 600
EPOCHS = 40
PRECISION = 0.999
UNKNOWN = "und"


def _features(column: pa.Array) -> tuple[DistinctWords, list[tuple[np.ndarray, np.ndarray]]]:
    words = DistinctWords(pc.utf8_lower(column), "letters")
    out = []
    for n in GRAMS:
        value, last = words.packed(n)
        bucket = mix(value.view(np.uint64) * np.uint64(8) + np.uint64(n)) & np.uint64(BUCKETS - 1)
        out.append((bucket.astype(np.int64), last))
    return words, out


def held_out(doc_id: Column) -> Column:
    """Column: the documents kept apart for measuring, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: unknown), score and acceptance of each text."""
        n = len(column)
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages or n == 0:
            return np.full(n, -1), np.zeros(n), np.zeros(n, bool)
        words, grams = _features(column)
        count = words.per_text(sum(words.per_word(np.ones(len(b)), at) for b, at in grams))
        z = np.stack([words.per_text(sum(words.per_word(self.logits[b, j], at) for b, at in grams)) for j in range(len(self.languages))], 1)
        p = _softmax((z / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        best = np.where(letters, p.argmax(1), -1)
        score = np.where(letters, p.max(1), 0.0)
        return best, score, letters & (score >= self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """``(lang, bucket, weight)`` lists of the sampled texts."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_language).drop("r")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, grams = _features(column_of(batch, "text"))
            owner = np.repeat(np.arange(len(words.start) - 1), np.diff(words.start))
            texts = []
            word_of = [np.sort(words.index[a:b]) for a, b in zip(words.words.first[:-1], words.words.first[1:], strict=True)]
            gram = np.concatenate([b for b, _ in grams])
            of = owner[np.concatenate([at for _, at in grams])]
            order = np.argsort(of, kind="stable")
            gram, bounds = gram[order], np.searchsorted(of[order], np.arange(len(words.start)))
            for own in word_of:
                n = bounds[own + 1] - bounds[own]
                at = np.repeat(bounds[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                bucket, count = np.unique(gram[at], return_counts=True)
                texts.append((bucket.tolist(), (count / max(1, count.sum())).tolist()))
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "lang"), pa.array([t[0] for t in texts], pa.list_(pa.int32())), pa.array([t[1] for t in texts], pa.list_(pa.float32()))], ["lang", "bucket", "weight"]
            )

    picked = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # at most per_language ids of each language
    return picked.select("lang", "text").mapInArrow(find, "lang string, bucket array<int>, weight array<float>")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """A model from the labelled texts of ``docs(doc_id, text, lang)`` that are not held out."""
    rows = _training_rows(docs, per_language).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    bucket, weight = rows["bucket"].combine_chunks(), rows["weight"].combine_chunks()
    n = len(rows)
    row = np.repeat(np.arange(n), np.diff(bucket.offsets.to_numpy()))
    x = np.zeros((n, BUCKETS), np.float32)
    x[row, bucket.flatten().to_numpy()] = weight.flatten().to_numpy()
    y = np.searchsorted(languages, rows["lang"].to_pylist())
    order = np.lexsort((x @ np.random.default_rng(1).normal(size=BUCKETS).astype(np.float32), y))  # rows arrive in any order
    x, y = x[order], y[order]
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    test, fit = order[: n // 5], order[n // 5 :]
    embedding = rng.normal(0, 0.5, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        rate = 8.0 * (1 - epoch / epochs) + 0.1
        for at in range(0, len(fit), 32):
            own = rng.choice(fit, 32)
            hidden = x[own] @ embedding
            slope = _softmax(hidden @ layer + bias)
            slope[np.arange(len(own)), y[own]] -= 1
            slope /= len(own)
            back = slope @ layer.T
            layer -= rate * 0.1 * hidden.T @ slope
            bias -= rate * 0.1 * slope.sum(0)
            used = np.flatnonzero(x[own].any(0))
            embedding[used] -= rate * 10 * x[own][:, used].T @ back
    logits = (embedding @ layer).astype(np.float64)
    measured = test if len(test) else fit
    z, truth = x[measured] @ logits + bias, y[measured]
    loss = [(-np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in 2.0 ** np.arange(-6, 5)]
    temperature = min(loss)[1]
    p = _softmax(z / temperature)
    score, right = p.max(1), p.argmax(1) == truth
    down = np.argsort(-score, kind="stable")
    precision = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
    enough = np.flatnonzero(precision >= PRECISION)
    reject_below = float(score[down[enough[-1]]]) if len(enough) else 1.0
    return Model(languages, logits, bias.astype(np.float64), float(temperature), reject_below)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` of every row, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, score, accepted = held.value.predict(column_of(batch, "text"))
            names = [held.value.languages[b] if b >= 0 else UNKNOWN for b in best.tolist()]
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), column_of(batch, "held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "accepted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
