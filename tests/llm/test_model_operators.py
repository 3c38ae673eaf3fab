"""Models, archives and neighbours: round trips, held-out accuracy, recall, plain versions."""

import base64
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language, neighbours, pseudo, quality, warc
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- archives ---------------------------------------------------------------------------------

PAGES = [(5, "http://a", "<p>x</p>"), (3, "http://b\r\nX: y", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "u", None), (2, "u", ""), (7, "é", "ünï" * 50_000), (7, "é", "ünï" * 50_000), (None, "n", "<p>x</p>"), (8, "l", "\r\n\r\n"), (10, "l", "only")]


@pytest.fixture(scope="session")
def pages(spark):
    return spark.createDataFrame([(*p, 1.0, "first") for p in PAGES], "page_id long, url string, html string, sha double, p string")


def plain_pages(rows, min_bytes=0):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    for page_id, _, html in rows:
        data = (html or "").encode()
        low = first.get(html or "") if len(data) >= min_bytes else None
        refers = low if low is not None and low != page_id else None
        yield page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers


@pytest.mark.parametrize("min_bytes, archive_bytes", [(0, 1 << 26), (5, 300)])
def test_archives_round_trip(spark, pages, tmp_path, min_bytes, archive_bytes):
    manifest = warc.write_archives(pages, f"file://{tmp_path}", min_bytes, archive_bytes=archive_bytes)
    rows = warc.read_archives(spark, manifest).collect()
    assert Counter(tuple(r[:5]) for r in rows) == Counter(plain_pages(PAGES, min_bytes))
    payloads = {r.page_id: r.payload for r in rows if r.record_type == "response"}
    for page_id, _, html in PAGES:
        if page_id in payloads:
            assert payloads[page_id] == (html or "").encode()
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)


def test_reader_in_small_pieces_and_other_tools():
    members = [warc.encode_record(i, "u", b"abc" * i, None if i % 3 else 0) for i in range(1, 9)]
    data = b"".join(members)
    rows = list(warc.read_records(io.BytesIO(data)))
    assert [r[0] for r in rows] == list(range(1, 9))
    assert [r[1] for r in rows] == [3 * i for i in range(1, 9)]
    assert b"WARC-Type: response" in zlib.decompressobj(31).decompress(members[0])

    class Drip(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    assert list(warc.read_records(Drip(data))) == rows


@pytest.mark.parametrize("spoil", ["payload", "length", "cut", "end"])
def test_reader_refuses_what_is_wrong(spoil):
    plain = zlib.decompressobj(31).decompress(warc.encode_record(1, "u", b"good payload", None))
    if spoil == "payload":
        plain = plain.replace(b"good payload", b"evil payload")
    elif spoil == "length":
        plain = plain.replace(b"application/http;msgtype=response\r\nContent-Length: ", b"application/http;msgtype=response\r\nContent-Length: 9")
    elif spoil == "end":
        plain = plain[:-2]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(plain) + packer.flush()
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-20] if spoil == "cut" else data)))


def test_no_pages_no_archives(spark, pages, tmp_path):
    manifest = warc.write_archives(pages.limit(0), f"file://{tmp_path}")
    assert manifest.count() == 0 and warc.read_archives(spark, manifest).count() == 0


# --- neighbours -------------------------------------------------------------------------------


def brute_neighbours(rows, k):
    """``{query: [(vec_id, distance)]}`` among the usable vectors of the usual length."""
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    width = Counter(len(v) for v in usable.values()).most_common(1)[0][0] if usable else 0
    usable = {i: np.array(v) for i, v in usable.items() if len(v) == width}
    return {i: sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in usable.items() if j != i)[:k] for i, q in usable.items()}


def test_few_vectors_are_found_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(i, [1.0] * 6) for i in range(60, 90)] + [(90, None), (91, []), (92, [0.0] * 6), (93, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (94, [float("nan")] * 6), (95, [float("inf")] * 6), (96, [1.0] * 5), (None, [2.0] * 6), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, block int")
    found = defaultdict(list)
    for r in neighbours.nearest(df, df, 10, block=40, group=30).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((r.score, r.vec_id))
    expected = brute_neighbours(rows, 10)
    assert found.keys() == expected.keys()
    for q, best in expected.items():
        assert [j for _, j in found[q]] == [j for _, j in best]
        assert [s for s, _ in found[q]] == pytest.approx([s for s, _ in best], abs=1e-12)


def test_fewer_candidates_than_asked_and_no_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df, df.where("vec_id = 1"), 10).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 2, 0.0), (2, 3, 4.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df, df.limit(0)).count() == 0


def test_recall_on_clusters():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 32))[rng.integers(0, 50, 8_000)] + rng.normal(0, 0.6, (8_000, 32))
    ids = np.arange(8_000)
    found = defaultdict(set)
    for q, v, _ in neighbours.search_block(ids, x, ids[:60], x[:60], 10):
        found[q].add(v)
    hits = 0
    for q in range(60):
        distance = ((x - x[q]) ** 2).sum(1)
        distance[q] = np.inf
        hits += len(found[q] & set(np.argsort(distance)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected = brute_neighbours(rows, 10)
    found = QUERIES["op10_nearest_neighbours"](spark, SF).collect()
    hits = sum(r.vec_id in {j for _, j in expected[r.query_id]} for r in found)
    assert hits >= 0.9 * sum(len(v) for q, v in expected.items() if q % 100 == 0)


# --- language ---------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def spoken(spark):
    rng = random.Random(8)
    parts = {"aa": ["tha", "ing", "er", "the"], "bb": ["ção", "que", "os", "para"], "cc": ["szy", "czk", "ów", "nie"]}
    rows = []
    for i in range(900):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((i, text, lang, "x", 1.0))
    rows += [(None, rows[0][1], "aa", "x", 1.0), (1_000, None, "aa", "x", 1.0), (1_001, "", None, "x", 1.0), (1_002, "42 … !?", "aa", "x", 1.0), (1_003, "the " * 30_000, None, "x", 1.0), (5, rows[5][1], rows[5][2], "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out double")


def test_language_of_held_out_texts(spoken):
    rows = language.identify(spoken, language.train(spoken)).join(spoken.select("doc_id", "lang", "text").distinct(), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.text and any(c.isalpha() for c in r.text)]
    assert len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text)) for r in rows)
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r in held}
    accepted = [r for r in held if r.accepted]
    assert accepted and sum(r.lang == r.lang_pred for r in accepted) >= 0.97 * len(accepted)


def test_language_without_labels_or_rows(spoken):
    unlabelled = spoken.withColumn("lang", F.lit(None).cast("string"))
    model = language.train(unlabelled)
    assert {(r.lang_pred, r.score) for r in language.identify(unlabelled, model).collect()} == {("und", 0.0)}
    assert language.identify(spoken.limit(0), model).count() == 0
    assert language.identify(spoken, model).count() == spoken.count()


def test_language_of_long_texts_only(spark):
    rows = [(i, "the thing other " * 3, "aa") for i in range(30)] + [(i, "szyczk " * 150_000, "zz") for i in range(30, 34)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), epochs=2)
    assert model.languages == ["aa", "zz"]


def test_held_out_labels_are_not_learned_from(spoken):
    wrong = spoken.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in language.train(wrong).languages


# --- quality ----------------------------------------------------------------------------------


def plain_kneser_ney(texts, order):
    """A function from a word and a position to a probability, by the definition."""
    counts = [Counter() for _ in range(order + 1)]
    for text in texts:
        for w in text.encode().split():
            w = b"\x01" + w + b"\x02"
            for n in range(1, order + 1):
                for i in range(max(0, n - 1), len(w)):
                    if i > 0 and i - n + 1 >= 0:
                        counts[n][w[i - n + 1 : i + 1]] += 1
    adjusted = [Counter() for _ in range(order + 1)]
    for n in range(1, order + 1):
        if n == order:
            adjusted[n] = counts[n]
        else:
            for g in counts[n + 1]:
                adjusted[n][g[1:]] += 1
            for g, c in counts[n].items():
                if g[0] == 1:
                    adjusted[n][g] = c
    discounts = [None]
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == k for c in adjusted[n].values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        raw = [k - (k + 1) * y * b / a if a and b else u for k, a, b, u in ((1, n1, n2, 0.5), (2, n2, n3, 1.0), (3, n3, n4, 1.5))]
        discounts.append([min(max(d, 0.05), k) for k, d in enumerate(raw, 1)])

    def probability(gram):
        n = len(gram)
        shorter = 1 / 256 if n == 1 else probability(gram[1:])
        own = {g: c for g, c in adjusted[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return shorter
        total = sum(own.values())
        d = {g: discounts[n][min(c, 3) - 1] for g, c in own.items()}
        seen = (own[gram] - d[gram]) / total if gram in own else 0.0
        return seen + sum(d.values()) / total * shorter

    def word(w):
        w = b"\x01" + w + b"\x02"
        return sum(math.log(probability(w[max(0, i - order + 1) : i + 1])) for i in range(1, len(w)))

    return word


def test_kneser_ney_is_the_definition(spark):
    texts = ["abra cadabra abra", "banana band ban an", "cab cabs abba", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    import pyarrow as pa

    scorer = quality.Scorer(quality.kneser_ney(quality.gram_counts(df)).toArrow())
    word = plain_kneser_ney([t for t in texts if t], quality.ORDER)
    asked = ["abra", "band", "zebra cab", "", None, "banabra ñ"]
    logp, n = scorer.texts(pa.array(asked))
    for t, got, size in zip(asked, logp, n, strict=True):
        words = (t or "").encode().split()
        assert size == sum(len(w) + 1 for w in words)
        assert got == pytest.approx(sum(word(w) for w in words), rel=1e-9)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("abra cadabra banana",)], "text string")
    word = quality.Scorer(quality.kneser_ney(quality.gram_counts(df)).toArrow())
    level = {g: p for g, p in zip(word.levels[0][0], word.levels[0][1], strict=True)}
    unseen = 256 - sum(not math.isnan(p) for p in level.values())
    rows = quality.kneser_ney(quality.gram_counts(df)).where("n = 1 AND p IS NOT NULL").collect()
    counted = sum(r.p for r in rows)
    assert counted <= 1 and counted + unseen / 256 >= 1 - 1e-9


def test_quality_keeps_clean_and_rejects_junk(spark):
    rng = random.Random(3)
    clean = lambda: " ".join("".join(rng.choices(["ba", "lo", "mi", "ne"], k=3)) for _ in range(rng.randrange(20, 200)))
    junk = lambda: " ".join("".join(rng.choices("#$%&@!", k=6)) for _ in range(80))
    rows = [(i, clean(), "aa" if i % 2 else None) for i in range(200)] + [(i, junk(), "aa") for i in range(200, 220)] + [(220, None, "aa"), (221, "", None), (222, clean(), "new"), (None, clean(), "aa"), (0, junk(), "aa"), (223, "balomi " * 20_000, "aa")]
    docs = spark.createDataFrame([(*r, 1.0, "p") for r in rows], "doc_id long, text string, lang string, n double, gram string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 120)] + [(5, 0, 0), (6, 1, 1), (7, None, 0), (None, 1, 0), (200, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs, labels)
    assert judged.count() == len(rows)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    expected = Counter(r for r in rows if r[1] and "#" not in r[1] and "$" not in r[1])
    got = Counter((r.doc_id, r.text, r.lang) for r in kept.collect())
    assert sum((got - expected).values()) == 0 and sum(got.values()) >= 0.98 * sum(expected.values())
    assert quality.judge(docs.limit(0), labels).count() == 0
    no_trust = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.accepted == (r.perplexity is not None) for r in no_trust)


def test_model_runs_over_words(spark):
    import pyarrow as pa

    texts = ["abra cadabra a abra", "banana band a b ban", "cab  cabs\nabba", None, " "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    scorer = quality.Scorer(quality.kneser_ney(quality.gram_counts(df, of="across")).toArrow(), of="across")
    joined = lambda t: b"\x02".join((t or "").encode().split())
    text = plain_kneser_ney([joined(t).decode() for t in texts if joined(t)], quality.ORDER)
    asked = ["abra band", "band abra", "a a a", "", None, "zebra"]
    logp, n = scorer.texts(pa.array(asked))
    for t, got, size in zip(asked, logp, n, strict=True):
        assert size == sum(len(w) + 1 for w in (t or "").split())
        assert got == pytest.approx(text(joined(t)) if joined(t) else 0, rel=1e-9)
    assert logp[0] != pytest.approx(logp[1])


def test_quality_rejects_planted_words_and_repetition(spark):
    rng = random.Random(6)
    parts = ["ba", "lo", "mi", "ne", "ru", "to", "sa", "ke"]
    word = lambda: "".join(rng.choices(parts, k=rng.randrange(2, 4)))
    clean = lambda: [word() for _ in range(rng.randrange(70, 200))]
    rows = [(i, clean()) for i in range(600)]
    rows += [(i, w[:40] + ["wqyfxg"] + w[40:]) for i in range(1_000, 1_020) for w in [clean()]]
    rows += [(i, [word()] * 150) for i in range(2_000, 2_020)] + [(i, [a, b] * 75) for i in range(2_020, 2_030) for a, b in [(word(), word())]]
    docs = spark.createDataFrame([(i, " ".join(w), "aa") for i, w in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(480)] + [(i, 1, 1) for i in range(1_000, 1_010)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.accepted(docs, labels).select("doc_id").collect()}
    assert sum(i < 600 for i in kept) >= 0.97 * 600
    assert not [i for i in kept if i >= 1_000]


# --- pseudo-likelihood ------------------------------------------------------------------------


def test_network_gradient_and_normalisation():
    rng = np.random.default_rng(0)
    network = pseudo.Network.start(rng.integers(1, 100, pseudo.IDS).astype(float))
    network.flat += rng.normal(0, 0.1, len(network.flat)).astype(np.float32)
    context = rng.integers(0, pseudo.IDS + 1, (1, 2 * pseudo.SIDE))
    every = network.log_probability(np.arange(pseudo.IDS), np.repeat(context, pseudo.IDS, 0))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)
    ids = np.array([37])
    before = network.log_probability(ids, context)[0]
    for _ in range(5):
        network.learn(ids, context, 0.05)
    assert network.log_probability(ids, context)[0] > before


def test_score_is_the_sum_over_both_sides(spark):
    docs = spark.createDataFrame([(1, "a b c a b", 1), (2, None, 1), (None, "", 1), (3, "b", 1), (3, "b", 1), (4, "a b " * 5_000, 1)], "doc_id long, text string, ids int")
    tokens, network = pseudo.train(docs)
    rows = {(r.doc_id, r.n_tokens): r for r in pseudo.score(docs, (tokens, network)).collect()}
    assert rows[(2, 0)].log_likelihood == 0 and rows[(2, 0)].mean_log_probability is None and (None, 0) in rows
    from graphloom.llm.tokens import Words
    import pyarrow as pa

    ids = tokens.of(Words(pa.array(["a b c a b"]), "lower"))
    total = 0.0
    for i in range(5):
        around = [ids[i + s] if 0 <= i + s < 5 else pseudo.IDS for s in (-2, -1, 1, 2)]
        total += float(network.log_probability(ids[i : i + 1], np.array([around]))[0])
    assert rows[(1, 5)].log_likelihood == pytest.approx(total, rel=1e-5)
    assert rows[(4, 10_000)].mean_log_probability > rows[(3, 1)].mean_log_probability - 5


def test_training_learns_order(spark):
    rng = random.Random(1)
    cycle = " ".join(["red green blue"] * 400)
    shuffled = cycle.split()
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([(i, cycle) for i in range(60)] + [(100, " ".join(shuffled))], "doc_id long, text string")
    rows = {r.doc_id: r.mean_log_probability for r in pseudo.score(docs, pseudo.train(docs, rounds=3)).collect()}
    assert rows[0] > rows[100] + 0.3
    empty = docs.limit(0)
    assert pseudo.score(empty, pseudo.train(empty)).count() == 0


def test_unknown_words_cost_more_than_known_ones(spark):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(300)]
    rare = lambda: "".join(rng.choices("aeioulmnrst", k=7))
    docs = spark.createDataFrame([(i, " ".join(rng.choices(common, k=60) + [rare() for _ in range(70)])) for i in range(60)], "doc_id long, text string")
    model = pseudo.train(docs)
    texts = [(1, " ".join(rng.choices(common, k=50))), (2, " ".join(rare() for _ in range(50))), (3, " ".join("".join(rng.choices("#$%&@!", k=7)) for _ in range(50)))]
    mean = {r.doc_id: r.mean_log_probability for r in pseudo.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert mean[1] > mean[2] + 3 > mean[3] + 6


def test_every_position_is_learned_from():
    import pyarrow as pa
    from graphloom.llm.tokens import Words

    words = Words(pa.array(["a b c d e", None, "f " * 3_000, *[f"t{i} u v w x" for i in range(200)]]), "lower")
    for rounds in (pseudo.ROUNDS, 3):
        every = np.concatenate([pseudo.positions(words, number, rounds) for number in range(rounds)])
        assert sorted(every.tolist()) == list(range(4_005))


def test_models_are_fitted_on_every_trusted_document(spark):
    """Before, at most 10,000 of them counted."""
    docs = spark.range(10_400).select(F.col("id").alias("doc_id"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij").alias("text"))
    across, _ = quality.fit(docs, docs.select("doc_id"))
    wanted = quality.gram_counts(docs, of="across").groupBy("n").count()
    assert {r.n: r["count"] for r in wanted.collect()}[5] == len(across.levels[4][0])
