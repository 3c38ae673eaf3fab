"""Sentences, windows and the triple parser against plain restatements of the rules."""

import random

import pytest

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import table_functions
from graphloom.operators import triples as TR
from graphloom.operators.windows import WindowConfig, char_windows, sentence_windows

SPACE = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　"


def random_text(rng, n):
    return "".join(rng.choice(["a", "bc", "é", " ", ". ", "! ", "? ", ".", "。", "。 ", "\n", "\xa0", "! 　"]) for _ in range(n))


def sentences(text):
    """Cut after an ending that white space follows."""
    out, current = [], ""
    for i, ch in enumerate(text):
        if ch.isspace() and current.strip() and (current.rstrip()[-1] in ".!?。！？") and text[i - 1] != "":
            gap = current[len(current.rstrip()) :]
            if not gap or all(c.isspace() for c in gap):
                current += ch
                continue
        if current and current[-1].isspace() and current.strip() and current.rstrip()[-1] in ".!?。！？":
            out.append(current)
            current = ""
        current += ch
    out.append(current)
    return [s.strip() for s in out if s.strip()]


def test_split_and_spans(spark):
    rng = random.Random(4)
    texts = [random_text(rng, rng.randint(0, 60)) for _ in range(300)] + ["", "   ", "no end", "One. Two.", "a. \n b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", "text", T.split_sentences("text").alias("s"), T.sentence_spans("text").alias("p")).collect()
    for r in rows:
        assert r.s == sentences(r.text), r.text
        assert [p.text for p in r.p] == r.s
        for p in r.p:
            assert r.text[p.start : p.end].strip() == p.text
        for a, b in zip(r.p, r.p[1:]):
            assert a.end <= b.start and not r.text[a.end : b.start].strip()


def test_known_sentences(spark):
    one = "Google was founded by Larry Page and Sergey Brin in September 1998."
    four = "The capital of the United States is Washington D.C. is large. It is old. It is big."
    df = spark.createDataFrame([(one,), (four,)], "text string")
    counts = [r.n for r in df.select(F.size(T.split_sentences("text")).alias("n")).collect()]
    assert counts == [1, 4]


def test_white_space_helpers(spark):
    texts = [f"{a}x{b}y{a}" for a in SPACE for b in (" ", "  ", "\xa0", " \n ")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", T.strip("text").alias("a"), T.squeeze("text").alias("b"), T.token_count("text").alias("n")).collect():
        assert r.a == r.text.strip()
        assert r.b == " ".join(r.text.split())
        assert r.n == len(r.text.split())


def test_pick_sentence(spark):
    long = "x" * 500
    rows = [("A b. C d! E", "1"), ("A b. C d! E", "9"), (long, "-1"), (long, None), ("A.", "no"), (None, "0"), ("", "0")]
    df = spark.createDataFrame(rows, "text string, n string")
    got = [r.s for r in df.select(T.pick_sentence("text", "n", 400).alias("s")).collect()]
    assert got == ["C d!", "A b. C d! E", long[:400] + "...", long[:400] + "...", "A.", "", ""]
    whole = [r.s for r in df.select(T.pick_sentence("text", "n").alias("s")).collect()]
    assert whole == ["C d!", "A b. C d! E", long, long, "A.", "", ""]


def test_clamp_facts(spark):
    df = spark.createDataFrame([(["  a ", None, "", "bbbb   b", "c", "d"],)], "facts array<string>")
    assert df.select(T.clamp_facts("facts", 3, 6).alias("f")).first().f == ["a", "bbbb…", "c"]


def brute_windows(text, size, shared, count=lambda texts: [len(t.split()) for t in texts]):
    """Indices of sentences per window, replayed sentence by sentence."""
    if not text.strip():
        return []
    if count([text])[0] <= size:
        return [text]
    spans = T.spans_of(text)
    cost = count([s for _, _, s in spans])
    windows, open_ = [], []
    for i in range(len(spans)):
        if cost[i] > size:
            if open_:
                windows.append(list(open_))
            windows.append([i])
            open_ = []
            continue
        if open_ and sum(cost[j] for j in open_) + cost[i] > size:
            windows.append(list(open_))
            tail = []
            for j in reversed(open_):
                if shared <= 0 or sum(cost[k] for k in tail) + cost[j] > shared:
                    break
                tail = [j, *tail]
            open_ = tail
        open_.append(i)
    if open_:
        windows.append(open_)
    return [text[spans[w[0]][0] : spans[w[-1]][1]] for w in windows]


@pytest.mark.parametrize("long", [1 << 20, 40])
def test_sentence_windows(spark, long):
    """Inside rows, and with the sentences of all but the shortest texts as rows."""
    rng = random.Random(9)
    texts = []
    for _ in range(200):
        texts.append(" ".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 5, 9, 30]))) + "." for _ in range(rng.randint(0, 12))))
    texts += [None, "", " \n " * 40, "  Lead. " + "a b c. " * 900, "one " * 3000 + ". x", texts[7], "x" * 100]
    for shared in (0, 6, 15):
        cfg = WindowConfig(window_size=16, overlap=shared)
        df = spark.createDataFrame([(i, t, i, "r") for i, t in enumerate(texts)], "i int, text string, row int, piece string")
        got = {}
        for r in sentence_windows(df, cfg, long=long).orderBy("i", "chunk_id").collect():
            assert texts[r.i][r.start : r.end] == r.text and r.row == r.i and r.piece == "r"
            assert r.chunk_id == len(got.setdefault(r.i, []))
            got[r.i].append(r.text)
        for i, text in enumerate(texts):
            assert got.get(i, []) == brute_windows(text or "", 16, shared)


@pytest.mark.parametrize("long", [1 << 20, 40])
def test_sentence_windows_with_another_count(spark, long):
    """A count that gives some sentences no token and others many."""
    count = lambda texts: [t.count("t") for t in texts]
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice(["t", "x", "tttt", "t" * 20]) for _ in range(rng.randint(1, 4))) + "." for _ in range(rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for shared in (0, 7):
        got = {}
        for r in sentence_windows(df, WindowConfig(window_size=16, overlap=shared), count, long).orderBy("i", "chunk_id").collect():
            got.setdefault(r.i, []).append(r.text)
        assert [got.get(i, []) for i in range(len(texts))] == [brute_windows(t, 16, shared, count) for t in texts]


def test_window_sizes_are_clamped():
    assert (WindowConfig(window_size=4).tokens, WindowConfig(window_size=9999).tokens) == (16, 512)
    assert (WindowConfig(window_size=20, overlap=50).shared, WindowConfig(overlap=-3).shared) == (19, 0)


def test_char_windows(spark):
    rng = random.Random(2)
    texts = [" ".join("w" * rng.randint(1, 8) for _ in range(rng.randint(0, 120))) for _ in range(80)] + ["", "  "]
    cfg = WindowConfig(window_size=16, overlap=5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {}
    for r in char_windows(df, cfg).orderBy("i", "chunk_id").collect():
        got.setdefault(r.i, []).append((r.start, r.end, r.text))
    for i, text in enumerate(texts):
        expected, start = [], 0
        if text.strip() and len(text.split()) <= 16:
            expected = [(0, len(text), text)]
        elif text.strip():
            while True:
                end = min(start + 64, len(text))
                expected.append((start, end, text[start:end]))
                if end == len(text):
                    break
                start += 44
        assert got.get(i, []) == expected


def brute_triples(text):
    """The rules of the linearised form, by splitting."""
    for mark in ("<s>", "</s>"):
        text = text.replace(mark, "")
    out = []
    for content in text.split("<triplet>")[1:]:
        content = content.split("</triplet>")[0]
        head, *rest = content.split("<subj>")
        clean = lambda x: " ".join(x.replace("</subj>", "").replace("</obj>", "").replace("<obj>", "").replace("<subj>", "").split())
        head, tail = clean(head), ""
        for piece in rest:
            tail += piece
            if "<obj>" in tail:
                left, right = tail.split("<obj>", 1)
                triple = (head, clean(right), clean(left))
                if all(triple):
                    out.append(triple)
                tail = ""
    return out


def test_parse_triples(spark):
    rng = random.Random(7)
    marks = ["<triplet> a <subj> b c <obj> d", " <subj> x\n<obj>y  z", "<subj>", "<obj>", "<triplet>", "</triplet>", " w ", "</s>", "</subj>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "i int, window_idx int, text string")
    got = {}
    for r in TR.parse_triples(df).orderBy("i", "pos").collect():
        got.setdefault(r.i, []).append((r["head"], r.relation, r.tail))
    for i, text in enumerate(texts):
        assert got.get(i, []) == brute_triples(text), text
    assert sum(map(len, got.values())) > 100


def test_two_triples_make_three_entities(spark):
    rows = [("d", 0, 0, "United States", "capital", "Washington D.C.", 1.0), ("d", 0, 1, "Joe Biden", "president_of", "United States", 1.0)]
    g = TR.triples_to_graph(
        spark.createDataFrame(rows, "graph_id string, window_idx int, pos int, head string, relation string, tail string, score double")
    )
    labels = {r.node_id: r.label for r in g.nodes.collect()}
    assert labels == {"entity_0": "United States", "entity_1": "Washington D.C.", "entity_2": "Joe Biden"}
    edges = [(e.source, e.target, e.metrics["weight"]) for e in g.edges.orderBy("ord").collect()]
    assert edges == [("entity_0", "entity_1", 1.0), ("entity_2", "entity_0", 1.0)]


def test_merge_keeps_first_form_and_best_score(spark):
    rows = [
        ("d", 0, 0, "A  b", "r", "C", 0.4, 0),
        ("d", 1, 0, "a b", "R", "c", 0.9, 1),
        ("d", 1, 1, "a b", "r2", "c", 0.1, 1),
    ]
    df = spark.createDataFrame(
        rows, "doc_id string, window_idx int, pos int, head string, relation string, tail string, score double, chunk_id int"
    )
    got = {(r["head"], r.relation, r.tail, r.score, r.chunk_id, r.mentions) for r in TR.merge_triples(df).collect()}
    assert got == {("A b", "r", "C", 0.9, 0, 2), ("a b", "r2", "c", 0.1, 1, 1)}
    assert TR.mention_chunks(df).count() == 3


def test_relation_records(spark):
    docs = [
        ("a", '{"relationships":[{"startEntity":{"name":"Paris"},"endEntity":{"label":" France "},"name":"capital_of"}]}'),
        ("b", '{"relations":[],"edges":[{"source":"x","target":"y","type":"t"},{"source":"","subject":"s","object":"o","rel":"q"}]}'),
        ("c", '{"relations":[{"head":"h","tail":"","object":{}}]}'),
        ("d", "no json"),
    ]
    df = spark.createDataFrame(docs, "graph_id string, json string")
    got = [(r.graph_id, r["head"], r.relation, r.tail) for r in TR.relations_to_triples(df).orderBy("graph_id", "pos").collect()]
    assert got == [("a", "Paris", "capital_of", "France"), ("b", "x", "t", "y"), ("b", "s", "q", "o")]


def test_empty_input_says_so(spark):
    facts = spark.createDataFrame([("a", []), ("b", ["x"])], "graph_id string, facts array<string>")
    triples = spark.createDataFrame([("b",)], "graph_id string")
    stats = TR.extraction_stats(facts, triples, F.lit("2024-02-01").cast("timestamp"), F.lit(5))
    meta = {r.graph_id: r.meta for r in stats.collect()}
    assert meta["a"] == {"extractor": "itext2kg", "reason": "empty_input"}
    assert meta["b"]["triple_count"] == "1" and meta["b"]["obs_timestamp"] == "01-02-2024"


def test_ordinals_of_one_giant_key(spark):
    from graphloom.operators.topology import ordinals

    rows = [("hot", i * 3) for i in range(5000)] + [("cold", 5), ("cold", 1)]
    df = spark.createDataFrame(rows, "k string, at long")
    got = ordinals(df, ["k"], F.floor(F.col("at") / 1000), [F.floor(F.col("at") / 100)], [F.col("at")], "n").collect()
    assert {(r.k, r.at, r.n) for r in got} == {("hot", i * 3, i) for i in range(5000)} | {("cold", 1, 0), ("cold", 5, 1)}


def test_records_path(spark):
    def relate(batches):
        import json

        def one(facts):
            return json.dumps({"relations": [{"startEntity": {"name": "Paris"}, "endEntity": {"name": "France"}, "name": f"in {len(facts)} facts"}]})

        return batches.map(one)

    docs = spark.createDataFrame([("a", "Paris is the capital of France. It is old."), ("b", "  "), ("c", None)], "graph_id string, text string")
    g = TR.extract_records(docs, relate, F.lit("2024-02-01").cast("timestamp"))
    assert [(e.graph_id, e.source, e.target, e.relation) for e in g.edges.collect()] == [("a", "ent:1", "ent:2", "in 2 facts")]
    heads = {r.graph_id: r.meta for r in g.graphs.collect()}
    assert heads["b"]["reason"] == heads["c"]["reason"] == "empty_input" and heads["a"]["atomic_facts"] == "2"


def test_table_function(spark):
    """Odd texts as the column parser reads them, keys of any type, a model of the caller."""
    texts = [
        "<s><triplet> A b <subj> C <obj> r</s>", "", None, "no markers", "<triplet> A <subj> B <subj> C <obj> r <subj> D <obj> s", "<triplet> A <subj> B <obj> r </triplet> rest <subj> X <obj> y",
        "<triplet><subj> B <obj> r", "<triplet> A <subj> <obj> r <triplet> A  x <subj> B\n <obj> r <obj> q", "<subj> B <obj> r", "<triplet> A <subj> B <obj> r<triplet> A <subj> B <obj> r",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    name = table_functions.register(spark)
    made = spark.sql(f"SELECT t.* FROM {{rows}} r, LATERAL {name}(r.i, 0, r.text) t", rows=rows)
    assert made.schema["key"].dataType.simpleString() == "bigint"
    parsed = TR.parse_triples(rows)
    plain = lambda df, key: sorted((r[key], r.pos, r["head"], r.relation, r["tail"], r.score) for r in df.collect())
    assert plain(made, "key") == plain(parsed, "i") and len(plain(parsed, "i")) >= 6
    own = table_functions.register(spark, lambda text: f"<triplet> {text} <subj> b <obj> c", "own_triples", 0.5)
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM {own}('k', 3, 'a')").collect()] == [("k", 3, 0, "a", "c", "b", 0.5)]
    with pytest.raises(Exception, match="must be a string"):
        spark.sql(f"SELECT * FROM {name}(1, 2, 3)").collect()


def test_numbering_shuffles_rows_once(spark):
    """Rows are numbered by the column that their offsets are joined by; before, they were dealt once for each."""
    from graphloom.operators.topology import ordinals

    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("at"))
    plan = ordinals(df, ["k"], F.floor(F.col("at") / 50), [F.floor(F.col("at") / 10)], [F.col("at")], "n")._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(__place" in plan


def test_triples_beyond_one_batch(spark):
    many = TR.PARSED + 5
    df = spark.createDataFrame([("a", 0, "<triplet> h <subj> t <obj> r" * many), ("b", 1, None), ("c", 2, "<triplet> x <subj> y <obj> z")], "g string, window_idx int, text string")
    got = TR.parse_triples(df).groupBy("g", "window_idx").agg(F.count("*").alias("n"), F.max("pos").alias("last")).orderBy("g").collect()
    assert [tuple(r) for r in got] == [("a", 0, many, many - 1), ("c", 2, 1, 0)]


def test_squeezed_triples_merge_alike(spark):
    rows = [("d", i % 3, i, "A b", "r", "C" if i % 2 else "c", 0.1 * i, i % 3) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id string, window_idx int, pos int, head string, relation string, tail string, score double, chunk_id int")
    assert TR.merge_triples(df, squeezed=True).collect() == TR.merge_triples(df).collect()
