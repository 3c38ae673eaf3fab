"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

The vocabulary is counted over all documents: the most frequent words have an id each. A token is predicted from the
``SIDE`` tokens before and behind it (it is itself masked): their embeddings, weighted by position, go through a
tanh layer, then a softmax over groups of ids and one over the ids of the group. The other words, however many,
share the ids of the last groups, by hash, as neighbours and in training; as a token such a word has the probability of these groups
together, times that of its spelling: an interpolated Kneser-Ney model of the byte n-grams (order ``SPELLING``) of all such
words of all documents, which leaves mass to words never seen. A document's score is the sum of the conditional
log-probabilities of its tokens.

Training is stochastic gradient descent in numpy inside the tasks: from common weights, each task learns
on every document it holds and the weights of all tasks are averaged by the number of tokens, over ``ROUNDS``
rounds. A hash deals the positions to the rounds, so every token is predicted once. Sums go by weight block
through a two-level tree, so the driver receives one set of weights however many tasks there are.

Defined results: a text without words, or null, has 0 tokens, score 0 and a null mean; a window reaches
over a text's ends as padding; repeated rows get equal scores; ties in the vocabulary go to the smaller hash;
with no words at all every score is 0; an empty table gives no rows; other columns are ignored.
Weights depend on how the documents are spread over tasks, so scores of two runs on different layouts differ slightly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.quality import Scorer, gram_counts, kneser_ney
from graphloom.llm.subwords import DistinctWords
from graphloom.llm.tokens import Words, column_of, mix, slices
from graphloom.session import cut

IDS = 1024
REST = 64
GROUP = 32
WIDTH = 16
SIDE = 2
ROUNDS = 2
BATCH = 2048
SPELLING = 3
RATE = 0.5
BLOCKS = 16
LANES = 32


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the frequent words and their counts, most frequent first, and the counts of all words by rest id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            word, n = np.unique(Words(column_of(batch, "text"), "lower").hashes, return_counts=True)
            for at in range(0, len(word), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(word[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000].astype(np.int64))], ["word", "n"])

    counts = cut(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(IDS - REST).collect()
    by_rest = np.zeros(REST)
    for r in counts.groupBy(F.col("word").bitwiseAND(REST - 1).alias("rest")).agg(F.sum("n").alias("n")).collect():
        by_rest[r.rest] = r.n
    return np.array([r.word for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.float64), by_rest


class Tokens:
    """Ids of words and the neighbours from which each is predicted."""

    def __init__(self, words: np.ndarray):
        self.ids = np.arange(len(words))
        order = np.argsort(words)
        self.sorted, self.id_of = words[order], order
        self.spelling: Scorer | None = None

    def of(self, words: Words) -> np.ndarray:
        h = words.hashes
        rest = IDS - REST + (h & np.uint64(REST - 1)).astype(np.int64)
        if len(self.sorted) == 0:
            return rest
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.id_of[at], rest)

    def read(self, column: pa.Array) -> tuple[DistinctWords, np.ndarray]:
        """The distinct words of a column, and a mask of the words without an id of their own."""
        words = DistinctWords(column, "lower")
        return words, self.of(words.words) >= IDS - REST

    @staticmethod
    def context(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ids around the positions ``at``; ``IDS`` beyond a text's ends."""
        owner = np.searchsorted(first, at, side="right") - 1
        low, high = first[owner], first[owner + 1]
        out = np.empty((len(at), 2 * SIDE), np.int64)
        for j, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            place = at + shift
            inside = (place >= low) & (place < high)
            out[:, j] = np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], IDS)
        return out


class Network:
    """Weights in one flat array, with views by name."""

    SHAPES = {
        "embedding": (IDS + 1, WIDTH),
        "position": (2 * SIDE, WIDTH),
        "bias": (WIDTH,),
        "group": (WIDTH, IDS // GROUP),
        "group_bias": (IDS // GROUP,),
        "word": (IDS // GROUP, WIDTH, GROUP),
        "word_bias": (IDS // GROUP, GROUP),
    }
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 11) -> Network:
        """Small random weights and biases that give the unigram distribution."""
        rng = np.random.default_rng(seed)
        out = cls(np.zeros(cls.SIZE, np.float32))
        out.embedding[:] = rng.normal(0, 0.3, out.embedding.shape)
        out.position[:] = 1 + rng.normal(0, 0.1, out.position.shape)
        out.group[:] = rng.normal(0, 0.1, out.group.shape)
        out.word[:] = rng.normal(0, 0.1, out.word.shape)
        p = (counts + 0.5).reshape(-1, GROUP)
        out.group_bias[:] = np.log(p.sum(1) / p.sum())
        out.word_bias[:] = np.log(p / p.sum(1, keepdims=True))
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = np.broadcast_to(self.bias, (len(context), WIDTH)).copy()
        for j in range(2 * SIDE):
            total += self.embedding[context[:, j]] * self.position[j]
        return np.tanh(total)

    def log_probability(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        h = self.hidden(context)
        group, inner = ids // GROUP, ids % GROUP
        z = h @ self.group + self.group_bias
        out = z[np.arange(len(ids)), group] - _logsum(z)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(IDS // GROUP + 1))
        for g in range(IDS // GROUP):
            own = order[bounds[g] : bounds[g + 1]]
            if len(own):
                z = h[own] @ self.word[g] + self.word_bias[g]
                out[own] += z[np.arange(len(own)), inner[own]] - _logsum(z)
        return out

    def log_rest(self, context: np.ndarray) -> np.ndarray:
        """Log-probability that a word without an id of its own stands there."""
        z = self.hidden(context) @ self.group + self.group_bias
        return _logsum(z[:, (IDS - REST) // GROUP :]) - _logsum(z)

    def learn(self, ids: np.ndarray, context: np.ndarray, rate: float) -> None:
        """One step of gradient descent on a batch."""
        n = len(ids)
        h = self.hidden(context)
        group, inner = ids // GROUP, ids % GROUP
        slope = _softmax(h @ self.group + self.group_bias)
        slope[np.arange(n), group] -= 1
        back = slope @ self.group.T
        self.group -= rate / n * (h.T @ slope)
        self.group_bias -= rate / n * slope.sum(0)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(IDS // GROUP + 1))
        for g in range(IDS // GROUP):
            own = order[bounds[g] : bounds[g + 1]]
            if len(own):
                s = _softmax(h[own] @ self.word[g] + self.word_bias[g])
                s[np.arange(len(own)), inner[own]] -= 1
                back[own] += s @ self.word[g].T
                self.word[g] -= rate / n * (h[own].T @ s)
                self.word_bias[g] -= rate / n * s.sum(0)
        back *= 1 - h * h
        self.bias -= rate / n * back.sum(0)
        for j in range(2 * SIDE):
            e = self.embedding[context[:, j]]
            order = np.argsort(context[:, j], kind="stable")
            near, head = np.unique(context[order, j], return_index=True)
            self.embedding[near] -= rate / n * 16 * np.add.reduceat(back[order], head) * self.position[j]
            self.position[j] -= rate / n * (back * e).sum(0)


def _logsum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Tokens, Network]:
    """Vocabulary and network learned from all texts of ``docs``."""
    words, counts, rest = vocabulary(docs)
    # rest counts hold the frequent words too: take these off
    taken = np.bincount((words & np.uint64(REST - 1)).astype(np.int64), weights=counts, minlength=REST) if len(words) else np.zeros(REST)
    by_id = np.zeros(IDS)
    by_id[: len(words)] = counts
    by_id[IDS - REST :] = np.maximum(rest - taken, 0)
    tokens, network = Tokens(words), Network.start(by_id)
    for number in range(rounds if len(words) else 0):
        network = Network(_averaged(docs, tokens, network, number, rounds, RATE / (1 + number)))
    tokens.spelling = Scorer(kneser_ney(cut(gram_counts(docs, SPELLING, read=tokens.read)), SPELLING).toArrow(), SPELLING)
    return tokens, network


def positions(words: Words, number: int, rounds: int) -> np.ndarray:
    """The positions of a round in mixed order; each position is in one of the rounds."""
    inside = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)
    picked = np.flatnonzero((mix(words.hashes + inside.astype(np.uint64)) + np.uint64(number)) % np.uint64(rounds) == 0)
    return picked[np.argsort(mix(picked.astype(np.uint64)))]


def _averaged(docs: DataFrame, tokens: Tokens, network: Network, number: int, rounds: int, rate: float) -> np.ndarray:
    held = docs.sparkSession.sparkContext.broadcast((tokens, network.flat))
    size = -(-Network.SIZE // BLOCKS)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, flat = held.value
        own, seen = Network(flat.copy()), 0
        for batch in slices(batches):
            words = Words(column_of(batch, "text"), "lower")
            ids = tokens.of(words)
            picked = positions(words, number, rounds)
            for at in range(0, len(picked), BATCH):
                some = picked[at : at + BATCH]
                own.learn(ids[some], tokens.context(ids, words.first, some), rate * len(some) / BATCH)
            seen += len(picked)
        lane = TaskContext.get().partitionId() % LANES
        parts = [(own.flat[b * size : (b + 1) * size].astype(np.float64) * seen).tobytes() for b in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(BLOCKS, lane), pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], ["lane", "block", "n", "sums"]
        )

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for blob in rows["sums"]:
            part = np.frombuffer(blob.as_py(), np.float64)
            total = part.copy() if total is None else total + part
        first = rows.slice(0, 1)
        return pa.table({"lane": first["lane"], "block": first["block"], "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "lane int, block int, n long, sums binary"
    sums = docs.select("text").mapInArrow(learn, schema).groupBy("lane", "block").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect()
    out = network.flat.copy()
    for row in sums:
        if row.n:
            part = np.frombuffer(row.sums, np.float64) / row.n
            out[row.block * size : row.block * size + len(part)] = part
    return out


def score(docs: DataFrame, model: tuple[Tokens, Network]) -> DataFrame:
    """``(doc_id, n_tokens, log_likelihood, mean_log_probability)`` of every document."""
    held = docs.sparkSession.sparkContext.broadcast((model[0], model[1].flat))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, network = held.value[0], Network(held.value[1])
        for batch in slices(batches):
            distinct, rest = tokens.read(column_of(batch, "text"))
            words = distinct.words
            ids, logp = tokens.of(words), np.zeros(len(words.hashes))
            if len(ids):
                logp[rest] = np.add.reduceat(tokens.spelling.bytes(distinct), distinct.start[:-1])[distinct.index[rest]]
            for at in range(0, len(ids), 65_536):
                some = np.arange(at, min(at + 65_536, len(ids)))
                other, some = some[rest[some]], some[~rest[some]]
                logp[some] = network.log_probability(ids[some], tokens.context(ids, words.first, some))
                logp[other] += network.log_rest(tokens.context(ids, words.first, other))
            total = np.concatenate([[0.0], np.cumsum(logp)])
            sums, n = total[words.first[1:]] - total[words.first[:-1]], words.counts
            mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(n), pa.array(sums), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, n_tokens long, log_likelihood double, mean_log_probability double")
