"""Quality classifier: interpolated modified Kneser-Ney models of trusted text.

One model is of byte n-grams (order ``ORDER``) that run over the borders of words: a text is its words with an end mark
behind each and a begin mark before the first. The other is of the order of words: n-grams of the distances at
which words come back (``copies``), so that it costs to repeat words more than trusted texts do. Counts,
continuation counts, discounts, context sums and interpolated probabilities are joins and aggregates on
(order, n-gram) keys, sharded by key. The models are fitted on all documents of three quarters of the trusted ones (by hash of
the id). Tasks hold the n-grams that are distinct in them, which grow far slower than the texts; each distinct
word of a slice is scored once for each of the bytes that stand before it.

A document is measured on several scales (``SCALES``): its least likely word, its least likely windows of several
lengths, and the whole of it, with ``PRIOR`` bytes at the mean of its language added so that short texts are not judged
by chance. A window's perplexity is taken per predicted byte (or word); a text shorter than a window is not measured by it.
The limit of each scale is a quantile over the trusted documents of the language that the models were not fitted on, so that a share of ``1 - QUANTILE``
of them at most lies over any. Where they are fewer than ``FEW``, it is about ``TAIL`` standard deviations over
the mean (of the logarithm), more for very few, if that is more than their largest. A language without such documents gets the limits of all. A document over a limit is rejected; ``perplexity`` and ``threshold`` are
those of the scale where their ratio is greatest.

Defined results: a text without words (null or empty too) has no perplexity and is rejected; a null language
is a language of its own; documents labelled more than once count once and are trusted only if every label
says so; without any trusted text nothing can be judged and every document with words is accepted; an
empty table gives no rows; other columns are carried along by :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.repeats import LAST
from graphloom.llm.subwords import DistinctWords, WordsInContext
from graphloom.llm.tables import unused
from graphloom.llm.tokens import Words, column_of, slices
from graphloom.session import cut

ORDER = 5
QUANTILE = 0.995
FEW, TAIL = 100, 3.0
PRIOR = 300.0
BACK = 8
#: bytes of text that are scored at a time, and distinct bytes whose n-grams are looked up at a time
SCORED, LOOKED_UP = 1 << 20, 1 << 17
#: bits that tell most other documents from trusted ones
MARKS = 1 << 24
#: windows of so many words, by the model of bytes; windows of so many words, by the model of their order
BYTES, COPIES = (1, 8, 32), (16, 64)
SCALES = [*(f"bytes{k}" for k in BYTES), *(f"copies{k}" for k in COPIES), "whole"]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that all labels call good and not toxic."""
    rows = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    fine = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
    return rows.agg(F.min(fine).alias("fine")).where("fine").select("doc_id")


def copies(words: Words) -> pa.Array:
    """For each text a word of digits: how many words before each of its words the same one stands (0: not within ``BACK``)."""
    h, owner = words.hashes, words.owner()
    digit = np.full(len(h), ord("0"), np.uint8)
    for k in range(BACK, 0, -1):
        digit[k:][(h[k:] == h[:-k]) & (owner[k:] == owner[:-k])] = ord("0") + k
    return pa.Array.from_buffers(pa.large_string(), len(words.first) - 1, [None, pa.py_buffer(words.first.astype(np.int64)), pa.py_buffer(digit)])


def _words(column: pa.Array, order: int, of: str) -> DistinctWords:
    """The words that a model is of: ``inside`` words, ``across`` their borders, or of ``copies``."""
    if of == "copies":
        column = copies(Words(column, "plain"))
    return WordsInContext(column, "plain", order - 1) if of == "across" else DistinctWords(column, "plain")


def gram_counts(texts: DataFrame, order: int = ORDER, of: str = "inside", read: Callable[[pa.Array], tuple[DistinctWords, np.ndarray]] | None = None) -> DataFrame:
    """``(n, gram, c)``: how often each n-gram occurs. Of the mark at a begin alone nothing is counted.

    ``read`` gives other distinct words of a column, and a mask of the words that count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = column_of(batch, "text")
            words, counted = read(text) if read else (_words(text, order, of), slice(None))
            times = np.bincount(words.index[counted], minlength=len(words.start) - 1)
            owner = np.repeat(np.arange(len(words.start) - 1), np.diff(words.start))
            predicted = words.predicted()
            for n in range(1, order + 1):
                value, last = words.packed(n)
                use = predicted[last] & (times[owner[last]] > 0)
                value, last = value[use], last[use]
                gram, at = np.unique(value, return_inverse=True)
                c = np.bincount(at, weights=times[owner[last]], minlength=len(gram)).astype(np.int64)
                for s in range(0, len(gram), 200_000):
                    part = slice(s, s + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram[part]), n, np.int32)), pa.array(gram[part]), pa.array(c[part])], ["n", "gram", "c"])

    return texts.select("text").mapInArrow(count, "n int, gram long, c long").groupBy("n", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(n, gram, p, g)``: interpolated probability of the last byte, and the weight that the n-gram as a context
    leaves to shorter ones (n = 0: to the uniform distribution).

    Below the highest order an n-gram counts by the distinct bytes before it, unless it starts with
    the begin mark, before which nothing can stand.
    """
    byte = F.lit(256).cast("long")
    power = F.expr("shiftleft(1L, 8 * (n - 1))")
    marked = F.floor(F.col("gram") / power) == 1
    own = counts.where((F.col("n") == order) | marked)
    spread = counts.where("n > 1").select((F.col("n") - 1).alias("n"), (F.col("gram") % power).alias("gram"))
    spread = spread.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("c"))
    adjusted = cut(own.unionByName(spread.join(own.select("n", "gram"), ["n", "gram"], "left_anti")).withColumn("ctx", F.floor(F.col("gram") / byte)))
    # discounts of each order from the numbers of n-grams seen once to four times
    tally = adjusted.where("c <= 4").groupBy("n", "c").count().collect()
    seen = {(r.n, r.c): r["count"] for r in tally}
    cases = []
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (seen.get((n, k), 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        usual = (0.5, 1.0, 1.5)
        wanted = [k - (k + 1) * y * b / a if a and b else usual[k - 1] for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cases.append([min(max(d, 0.05), k) for k, d in enumerate(wanted, 1)])
    rows = F.array(*[F.array(*[F.lit(float(d)) for d in case]) for case in cases])
    discount = F.element_at(F.element_at(rows, F.col("n")), F.least(F.col("c"), F.lit(3)).cast("int"))
    discounted = adjusted.withColumn("d", discount)
    # each level is written down: a plan of all levels in one would hold every shorter one many times
    contexts = cut(discounted.groupBy("n", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("left")))
    level = discounted.where("n = 1").join(contexts, ["n", "ctx"])
    model = cut(level.select("n", "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("left") / F.col("total") / 256).alias("p")))
    parts = [model]
    for n in range(2, order + 1):
        shorter = model.select((F.col("gram")).alias("short"), F.col("p").alias("q"))
        here = discounted.where(F.col("n") == n).join(contexts, ["n", "ctx"]).withColumn("short", F.col("gram") % F.lit(1 << (8 * (n - 1))))
        here = here.join(shorter, "short", "left").withColumn("q", F.coalesce("q", F.lit(1 / 256)))
        model = cut(here.select("n", "gram", ((F.col("c") - F.col("d") + F.col("left") * F.col("q")) / F.col("total")).alias("p")))
        parts.append(model)
    probabilities = parts[0]
    for part in parts[1:]:
        probabilities = probabilities.unionByName(part)
    weights = contexts.select((F.col("n") - 1).alias("n"), F.col("ctx").alias("gram"), (F.col("left") / F.col("total")).alias("g"))
    return probabilities.join(weights, ["n", "gram"], "full").select("n", "gram", "p", "g")


class Grams:
    """N-grams of one order under a hash, so that finding one costs a step or two and no sort of what is asked."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray, weight: np.ndarray):
        self.shift = np.uint64(63 - max(1, int(len(gram)).bit_length()))
        bucket = self._bucket(gram)
        order = np.argsort(bucket, kind="stable")
        self.gram = gram[order]
        self.start = np.searchsorted(bucket[order], np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        # the last row is that of n-grams that are not here
        self.logp, self.weight = np.append(logp[order], np.nan), np.append(weight[order], 0.0)

    def __getitem__(self, i: int) -> np.ndarray:
        """The n-grams, their log probabilities and their weights."""
        return (self.gram, self.logp[:-1], self.weight[:-1])[i]

    def _bucket(self, gram: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """The row of each n-gram."""
        bucket = self._bucket(gram)
        at, end = self.start[bucket], self.start[bucket + 1]
        row = np.full(len(gram), len(self.gram), np.int32)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.gram[at[live]] == gram[live]
            row[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return row


class Scorer:
    """The model by order."""

    def __init__(self, rows: pa.Table, order: int = ORDER, of: str = "inside"):
        self.order, self.of = order, of
        n = rows["n"].to_numpy()
        none = rows["g"].to_numpy()[n == 0]
        self.unseen = np.log(none[0] / 256 if len(none) else 1 / 256)
        self.levels = []
        for k in range(1, order + 1):
            own = np.flatnonzero(n == k)
            p, g = (rows[c].to_numpy()[own].astype(np.float64) for c in ("p", "g"))
            with np.errstate(divide="ignore"):
                self.levels.append(Grams(rows["gram"].to_numpy()[own], np.log(p), np.log(np.where(np.isnan(g), 1.0, g))))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(log probability, predicted bytes)`` of each text."""
        words, logp, size = self.words(column)
        return words.per_text(np.add.reduceat(logp, words.start[:-1]) if len(logp) else logp), words.per_text(size)

    def words(self, column: pa.Array) -> tuple[DistinctWords, np.ndarray, np.ndarray]:
        """The words of the model, the log probability of each of their bytes, and how many of each are predicted."""
        words = _words(column, self.order, self.of)
        return words, self.bytes(words), np.diff(words.start) - np.broadcast_to(words.lead, len(words.start) - 1).astype(float)

    def bytes(self, words: DistinctWords) -> np.ndarray:
        """The log probability of each byte of distinct words; 0 for what stands before them.

        The longest n-gram is looked for first; only where it is unknown, its context's weight is paid and the next shorter one looked for.
        """
        logp, every = np.zeros(len(words.data)), np.flatnonzero(words.predicted())
        for s in range(0, len(every), LOOKED_UP):
            at = every[s : s + LOOKED_UP]
            logp[at] = self._at(words, at)
        return logp

    def _at(self, words: DistinctWords, at: np.ndarray) -> np.ndarray:
        place = words.place[at]
        depth = np.minimum(place + 1, self.order)
        value = np.zeros(len(at), np.int64)
        for k in range(self.order):
            value |= np.where(place >= k, words.data[at - np.minimum(place, k)], np.uint8(0)).astype(np.int64) << (8 * k)
        total, unknown = np.zeros(len(at)), np.arange(len(at))
        for n in range(self.order, 0, -1):
            level, deep = self.levels[n - 1], depth[unknown] >= n
            asked, shallow = unknown[deep], unknown[~deep]
            gram = value[asked] & ((1 << 8 * n) - 1)
            p = level.logp[level.find(gram)]
            known = ~np.isnan(p)
            total[asked[known]] += p[known]
            missed, gram = asked[~known], gram[~known]
            if n > 1:
                context = self.levels[n - 2]
                total[missed] += context.weight[context.find(gram >> 8)]
            else:
                total[missed] += self.unseen
            unknown = np.concatenate([shallow, missed])
        return total


def worst(logp: np.ndarray, size: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """The greatest mean of ``-logp`` per ``size`` over the windows of each text; NaN for texts that are shorter."""
    out = np.full(len(first) - 1, np.nan)
    if len(logp) < window:
        return out
    total, length = (np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)]) for x in (-logp, size))
    mean = (total[window:] - total[:-window]) / (length[window:] - length[:-window])
    has = np.flatnonzero(np.diff(first) >= window)
    # each text's windows, then those that reach into the next one
    edges = np.stack([first[has], first[has + 1] - window + 1], 1).ravel()
    out[has] = np.maximum.reduceat(np.append(mean, -np.inf), edges)[::2] if len(has) else out[has]
    return out


def divided(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three quarters of the trusted documents, on which the models are fitted, and the others."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    return trusted.where(part > 0), trusted.where(part == 0)


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id may be among ``ids``, by a bit per hash, so that a join that follows does not shuffle the texts of all others."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(MARKS)) + 1
    marks = ids.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_at"))
    marks = marks.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_marks"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "_bucket")  # MARKS bits at most
    return marked.where(F.bit_get(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def fit(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> tuple[Scorer, Scorer]:
    """The models of bytes and of copies, from all of the trusted documents."""
    texts = cut(_likely(docs, trusted).join(trusted, "doc_id", "left_semi").select("text"))
    across, again = (Scorer(kneser_ney(cut(gram_counts(texts, order, of)), order).toArrow(), order, of) for of in ("across", "copies"))
    return across, again


def perplexities(docs: DataFrame, held: Broadcast) -> DataFrame:
    """``(doc_id, h, lang, logp, n, …)`` of every document, with the logarithms of its perplexities by scale but the whole; ``held`` are the two models."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across, again = held.value
        for batch in slices(batches, size=SCORED):
            text = column_of(batch, "text")
            words, logp, size = across.words(text)
            own = np.add.reduceat(logp, words.start[:-1]) if len(logp) else logp
            scales = [worst(own[words.index], size[words.index], words.words.first, k) for k in BYTES]
            digits, by_digit, _ = again.words(text)
            # the digits of all texts in order, without marks
            inside = digits.predicted() & np.append(digits.place[1:] > 0, False)
            length = np.bincount(np.repeat(np.arange(len(digits.start) - 1), np.diff(digits.start))[inside], minlength=len(digits.start) - 1)
            offset = np.concatenate([[0], np.cumsum(length)])
            n = length[digits.index]
            first = np.concatenate([[0], np.cumsum(n)])
            every = by_digit[inside][np.repeat(offset[digits.index], n) + np.arange(int(n.sum())) - np.repeat(first[:-1], n)]
            first = words.words.first
            scales += [worst(every, np.ones(len(every)), first, k) for k in COPIES]
            numbers = [pa.array(words.per_text(own)), pa.array(words.per_text(size)), *(pa.array(x, from_pandas=True) for x in scales)]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in ("doc_id", "h", "lang")), *numbers], ["doc_id", "h", "lang", "logp", "n", *SCALES[:-1]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(score, f"doc_id long, h long, lang string, logp double, n double, {', '.join(f'{c} double' for c in SCALES[:-1])}")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, tail: float = TAIL, prior: float = PRIOR) -> DataFrame:
    """``(doc_id, h, lang, perplexity, threshold, accepted)`` of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    trusted = cut(trusted_ids(labels))
    fitted, others = divided(trusted)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, fitted))
    scored = cut(perplexities(docs, held))
    held.destroy()
    good = scored.where("n > 0").join(trusted, "doc_id", "left_semi")
    mean = F.sum("logp") / F.sum("n")
    every = good.agg(mean.alias("mean_all"))
    by_language = good.groupBy("lang").agg(mean.alias("mean"))

    def smoothed(rows: DataFrame) -> DataFrame:
        means = by_language.withColumnRenamed("lang", "_lang")
        rows = rows.join(means, rows.lang.eqNullSafe(means._lang), "left").drop("_lang").join(F.broadcast(every))  # one row
        level = F.coalesce("mean", "mean_all", F.lit(0.0))
        return rows.withColumn("whole", F.when(F.col("n") > 0, -(F.col("logp") + prior * level) / (F.col("n") + prior))).drop("mean", "mean_all")

    judged = cut(smoothed(scored))
    good = judged.where("n > 0").join(others, "doc_id", "left_semi")
    share = (1 - quantile) / len(SCALES)

    def limit(c: str) -> Column:
        top = F.percentile_approx(c, F.lit(1 - share), F.lit(100_000))
        few = F.avg(c) + tail * (1 + 10 / F.count(c)) * F.stddev_samp(c)
        return F.when(F.count(c) < FEW, F.greatest(top, few)).otherwise(top)

    limits = good.groupBy("lang").agg(*[limit(c).alias(f"own_{c}") for c in SCALES]).withColumnRenamed("lang", "_lang")
    total = good.agg(*[limit(c).alias(f"all_{c}") for c in SCALES])
    rows = judged.join(limits, judged.lang.eqNullSafe(limits._lang), "left").join(F.broadcast(total))  # one row
    # a scale without limit is held against nothing
    scales = [F.struct((F.col(c) - top).alias("over"), F.exp(c).alias("perplexity"), F.exp(top).alias("threshold")) for c in SCALES for top in [F.coalesce(f"own_{c}", f"all_{c}")]]
    usual = F.struct(F.lit(None).cast("double").alias("over"), F.exp("whole").alias("perplexity"), F.lit(None).cast("double").alias("threshold"))
    most_over = F.array_max(F.filter(F.array(*scales), lambda x: x["over"].isNotNull()))
    rows = rows.withColumn("_w", F.coalesce(most_over, usual))
    fine = F.col("_w.perplexity").isNotNull() & (F.coalesce(F.col("_w.over"), F.lit(0.0)) <= 0)
    return rows.select("doc_id", "h", "lang", "_w.perplexity", "_w.threshold", fine.alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    d, h, lang = unused(docs, "_d", "_h", "_l")
    keep = judge(docs, labels).where("accepted").select(F.coalesce("doc_id", F.lit(LAST)).alias(d), F.col("h").alias(h), F.col("lang").alias(lang)).distinct()
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), h: F.xxhash64(F.col("text").cast("string"))})
    same = (F.col(f"k.{d}") == F.col(f"r.{d}")) & (F.col(f"k.{h}") == F.col(f"r.{h}")) & F.col("k.lang").cast("string").eqNullSafe(F.col(f"r.{lang}"))
    return keyed.alias("k").join(keep.alias("r"), same, "left_semi").select(*[F.col(f"k.`{c}`") for c in docs.columns])
