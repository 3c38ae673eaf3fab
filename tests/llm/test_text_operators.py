"""Operators on texts against plain versions, over messy rows and empty tables."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import decontaminate, jaccard, pieces, recompression, suffixes
from graphloom.llm.repeats import window_hashes, window_starts
from graphloom.llm.tokens import Words, slices


def same(df, expected):
    assert Counter(tuple(r) for r in df.collect()) == Counter(expected)


@pytest.mark.parametrize("module", [recompression, suffixes])
def test_repeats(docs, rows, module):
    expected = brute.removed_words(rows)
    assert sum(e[2] > 0 for e in expected) > 12
    same(module.digest(docs), expected)


@pytest.mark.parametrize("module", [recompression, suffixes])
def test_strip_keeps_columns_and_other_texts(docs, rows, module):
    stripped = module.strip(docs)
    assert stripped.columns == docs.columns
    removed = brute.removed_words(rows)
    got = Counter((r.doc_id, r.text) for r in stripped.collect())
    for (doc_id, text), (_, _, n, _) in zip(rows, removed, strict=True):
        assert n or got[(doc_id, text)] > 0


def test_hot_minimisers_are_counted_to_the_same_rows(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 2)
    same(suffixes.digest(docs), brute.removed_words(rows))


def test_many_places_of_one_key_are_not_sorted_together(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, " ".join(["x"] * 3_000))] + [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(40)] + ["x"] * 45 + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows_of, sizes = suffixes._suffix_rows, []

    def counted(docs, wanted, window):
        sizes.extend(r["count"] for r in wanted.groupBy("name").count().collect())
        return rows_of(docs, wanted, window)

    monkeypatch.setattr(suffixes, "_suffix_rows", counted)
    same(suffixes.digest(docs), brute.removed_words(rows))
    assert max(sizes, default=0) <= suffixes.GROUP


def test_suffixes_in_small_pieces(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "ROWS", 3)
    same(suffixes.digest(docs), brute.removed_words(rows))


def test_equal_windows_have_equal_anchors(rows):
    words = Words(pa.array([t for _, t in rows]), "plain")
    prints, whole = window_hashes(words.hashes), window_starts(words.first)
    for spans in (recompression.spans(words), suffixes.minimisers(words)[:1] + suffixes.minimisers(words)[2:]):
        name, start, count = spans
        anchor = np.zeros(len(words.hashes), np.uint64)
        covered = np.zeros(len(words.hashes), int)
        for a, s, n in zip(name, start, count, strict=True):
            anchor[s : s + n] = a
            covered[s : s + n] += 1
        assert (covered == whole).all()
        by_print: dict = {}
        for at in np.flatnonzero(whole):
            assert by_print.setdefault(int(prints[at]), int(anchor[at])) == int(anchor[at])


def test_anchors_do_not_depend_on_the_other_texts_of_a_slice():
    for seed in (161, 1_161, *range(60)):
        rng = random.Random(seed)
        size = rng.choice([2, 3, 10, 1000])
        passage = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(50, 70))]
        around = [[f"v{rng.randrange(size)}" for _ in range(rng.randrange(300))] for _ in range(2)]
        anchors = []
        for text in (passage, around[0] + passage + around[1]):
            words = Words(pa.array([" ".join(text)]), "plain")
            prints, found = window_hashes(words.hashes), {}
            for name, start, count in zip(*recompression.spans(words), strict=True):
                found |= {int(p): int(name) for p in prints[start : start + count]}
            anchors.append(found)
        assert anchors[0].items() <= anchors[1].items()


def test_passage_in_a_short_text_and_in_a_long_one(spark):
    rng = random.Random(161)
    size = rng.choice([2, 3, 10, 1000])
    passage = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(50, 70))]
    around = [[f"v{rng.randrange(size)}" for _ in range(rng.randrange(300))] for _ in range(2)]
    rows = [(1, " ".join(passage)), (2, " ".join(around[0] + passage + around[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    same(recompression.digest(docs), brute.removed_words(rows))


def test_long_words_of_two_letters_differ():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    hashes = Words(pa.array([word, word.translate(str.maketrans("ab", "ba"))]), "plain").hashes
    assert hashes[0] != hashes[1]


def test_jaccard(docs, rows):
    expected = brute.components(rows)
    assert len({e[2] for e in expected}) < len({e[0] for e in expected})
    same(jaccard.digest(docs), expected)


def test_jaccard_in_small_blocks(docs, rows, monkeypatch):
    for name, value in {"BLOCK": 2, "STAR_CELL": 2, "HOT": 1, "DEAL_ROWS": 50}.items():
        monkeypatch.setattr(jaccard, name, value)
    same(jaccard.digest(docs), brute.components(rows))


def test_representatives(docs, rows):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    expected = {(d, t) for (d, t), (_, _, c) in zip(rows, brute.components(rows), strict=True) if d == c}
    assert {(r.doc_id, r.text) for r in kept.collect()} == expected


def test_one_row_of_each_group(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, a + " x"), (2, a), (None, b), (None, b), (None, b + " y"), (3, ""), (3, "")]
    kept = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or " ")[:1]) for r in kept) == [(0, "b"), (1, "a"), (3, " ")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=12), st.sampled_from([50, 80, 100]))
def test_trie_finds_every_link(sets, percent):
    sketch = np.arange(64) % 7
    tokens = [np.array(sorted(s), np.uint64) * np.uint64(977) for s in sets]
    trie = jaccard.Trie(tokens, sketch)
    for probe, own in zip(tokens, sets, strict=True):
        order = np.lexsort((probe, sketch[probe & np.uint64(63)]))
        expected = {i for i, s in enumerate(sets) if 100 * len(own & s) >= percent * len(own | s)}
        assert set(trie.linked(probe[order], percent).tolist()) == expected


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=300), min_size=2, max_size=8))
def test_signatures_bound_the_difference(texts):
    sets = jaccard.Sets(pa.array([" ".join(t) for t in texts]))
    plain = [brute.shingles(" ".join(t)) for t in texts]
    signs = sets.signatures()
    assert sets.sizes.tolist() == [len(p) for p in plain]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            words = min(len(signs[i]), len(signs[j])) // 8
            differ = int(np.bitwise_count(jaccard._folded([signs[i]], words) ^ jaccard._folded([signs[j]], words)).sum())
            assert differ <= len(a ^ b)


ITEMS = [(1, None), (2, "one two"), (3, "nothing of the kind is anywhere in these texts at all today"), (4, None), (4, "Alone!"), (None, "x y"), (5, " ... ")]


def test_contamination(spark, docs, rows):
    items = [*ITEMS, (6, rows[4][1]), (7, " ".join((rows[29][1] or "x").split()[:14]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.contamination(rows, items)
    assert sum(e[5] for e in expected) > 5
    same(decontaminate.digest(decontaminate.find_contamination(docs, benchmark)), expected)
    in_parts = decontaminate.find_contamination(docs, benchmark, part=20)
    same(decontaminate.digest(in_parts), expected)
    assert in_parts.columns == [*docs.columns, "contamination"]


def test_pieces(docs, rows):
    coded = pieces.decode(pieces.encode(docs)).select("doc_id", "text", "ids", "decoded").collect()
    vocabulary = pieces.Vocabulary()
    unknown = pieces.Automaton(vocabulary).unknown
    score = dict(enumerate(vocabulary.scores.tolist()))
    normal = set(vocabulary.normal)
    for r in coded:
        assert r.decoded == r.text
        assert (r.ids is None) == (r.text is None)
        if r.text and len(r.text) < 3_000:
            best, ids = brute.segment(vocabulary, unknown, r.text)
            assert len(r.ids) <= len(r.text.encode()) + 1
            if set(ids) <= normal and set(r.ids) <= normal:
                assert sum(score[i] for i in r.ids) == pytest.approx(best)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80)), min_size=1, max_size=6))
def test_pieces_round_trip(texts):
    global CODER
    if "CODER" not in globals():
        vocabulary = pieces.Vocabulary()
        CODER = pieces.Automaton(vocabulary), pieces.Decoder(vocabulary)
    column = pa.array([None if t is None else t.encode(errors="ignore").decode() for t in texts], pa.string())
    assert CODER[1].decode(CODER[0].encode(column)).to_pylist() == column.to_pylist()


@pytest.mark.parametrize("make", [recompression.digest, recompression.strip, suffixes.digest, suffixes.strip, jaccard.digest, jaccard.representatives, lambda d: pieces.decode(pieces.encode(d))])
def test_empty_table(no_docs, make):
    assert make(no_docs).count() == 0


def test_empty_table_or_benchmark(spark, docs, no_docs, rows):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(no_docs, benchmark).count() == 0
    found = decontaminate.digest(decontaminate.find_contamination(docs, benchmark))
    same(found, brute.contamination(rows, []))


def test_slices_cut_between_texts_only():
    batch = pa.record_batch({"text": pa.array(["a" * 10, "b" * 50, None, "c", "d" * 9])})
    parts = [b.column(0).to_pylist() for b in slices([batch], size=12)]
    assert [t for p in parts for t in p] == batch.column(0).to_pylist() and len(parts) > 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), min_size=1, max_size=5))
def test_words(texts):
    texts = [None if t is None else t.encode(errors="ignore").decode() for t in texts]
    for kind, pattern in (("plain", brute.WHITE), ("letters", brute.LETTERS)):
        words = Words(pa.array(texts, pa.string()), kind)
        expected = [w for t in texts for w in pattern.findall((t or "").translate(brute.FOLD) if kind == "letters" else t or "")]
        assert [words.word(i).decode() for i in range(len(words.starts))] == expected
        distinct = {w: int(h) for w, h in zip(expected, words.hashes, strict=True)}
        assert len(set(distinct.values())) == len(distinct)
