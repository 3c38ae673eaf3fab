"""Alignment of two tokenizers against a plain version that encodes whole texts."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import alignment
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    """``[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)]``, and the links of each row."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    letters = alignment._letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a_model.id_to_token(i))

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        ends = []
        for ids, spell in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at := at + len(spell(i)), i))
            ends.append(out)
        links = [(x, y) for y, (s, e, _) in enumerate(ends[1]) for x, (u, v, _) in enumerate(ends[0]) if u < e and s < v] if len(a) < 3000 else None
        if links is None:
            links, x = [], 0
            for y, (s, e, _) in enumerate(ends[1]):
                while ends[0][x][1] <= s:
                    x += 1
                k = x
                while k < len(a) and ends[0][k][0] < e:
                    links.append((k, y))
                    k += 1
        both = {e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]}
        groups, low = [], 0
        for high in sorted(both):
            groups.append(",".join(str(i) for s, e, i in ends[0] if low < e <= high) + "|" + ",".join(str(i) for s, e, i in ends[1] if low < e <= high)) if len(a) < 3000 else groups.append(None)
            low = high
        docs.append((doc_id, a, b, groups, links))
    counts = Counter((a[x], b[y]) for _, a, b, _, links in docs for x, y in links)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for doc_id, a, b, groups, links in docs:
        own = [counts[a[x], b[y]] for x, y in links]
        best = sum(n == most[b[y]] for n, (_, y) in zip(own, links, strict=True))
        digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(own), digest))
    return out, docs


ODD = [
    "two  spaces   and more ", " lead", " x   y　z   w", "tab\t x \n\n y", "▁mark ▁ x", "<|endoftext|> <s> </s> <unk> <0x41>", "é è  ü ß 中文 字 😀 😀😀", "a\x00b \x1c x", "it's he'll 'tis '' 's",
    "​ x ﻿ y", "  x", "x́ y", "ﬁ ½ Å", " ", "  ", "\n", "ab" * 3000, "…… ¿¡ — –", "퟿ \U0010ffff x", "e\u0085f \u0085 g",
]


@pytest.fixture(scope="session")
def texts(rows):
    rng = random.Random(9)
    alphabet = "ab é中😀 \t ▁.'1X "
    return [*rows, *((100 + i, t) for i, t in enumerate(ODD)), *((200 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))) for i in range(150))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 7) for i, t in rows], "doc_id long, text string, slice string, known int")


def same(made, want):
    made, want = Counter(map(tuple, made)), list(want)
    short = Counter(r for r in want if r[-1] is not None)
    long = Counter(r[:-1] for r in want if r[-1] is None)
    assert sum(made.values()) == len(want)
    rest = made - short
    assert not short - made
    assert Counter({k[:-1]: n for k, n in rest.items()}) == long


@pytest.mark.parametrize("size", [alignment.SLICE_BYTES, 300])
def test_digest(spark, texts, size):
    want, _ = plain(texts)
    made = alignment.align(frame(spark, texts).repartition(3), digest=True, size=size)
    same(made.collect(), want)
    assert [f.dataType.simpleString() for f in made.schema][1:7] == ["bigint"] * 6


def test_links(spark, texts):
    own = [(i, t) for i, t in texts if i is not None and i not in (28, 29)]
    want, docs = plain(own)
    rows = {r.doc_id: r for r in alignment.align(frame(spark, own)).collect()}
    for (doc_id, a, b, groups, links), digest in zip(docs, want, strict=True):
        r = rows[doc_id]
        assert (r.a, r.b) == (a, b)
        assert sorted(zip(r.link_a, r.link_b, strict=True)) == sorted(links)
        assert sum(r.link_count) == digest[6] and sum(r.link_best) == digest[5]
        if None not in groups:
            made = [",".join(str(i) for i, g in zip(r.a, r.a_group, strict=True) if g == k) + "|" + ",".join(str(i) for i, g in zip(r.b, r.b_group, strict=True) if g == k) for k in range(len(groups))]
            assert made == groups


def test_chunks_are_tokenized_as_in_the_text():
    left, right = alignment.tokenizers(alignment.BYTE_LEVEL, alignment.PIECES)
    assert left.splits and right.splits
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", " ", "é", "中", " ", "\n", "'s", "9", "!", "the", " ", "😀", "\u0085"]) for _ in range(30)).strip("\u0000")
        per_text, chunk, a, a_n, b, b_n = alignment.encode_slice(pa.array([text]), left, right)
        for side, ids, n in ((left, a, a_n), (right, b, b_n)):
            at = alignment._bounds(n)
            assert [int(i) for c in chunk for i in ids[at[c] : at[c + 1]]] == side.encode([" " + text])[0]


def test_empty_table(spark):
    empty = frame(spark, [])
    assert alignment.align(empty, digest=True).collect() == [] and alignment.align(empty).collect() == []
    nothing = alignment.align(frame(spark, [(1, None), (2, ""), (None, None)]), digest=True).collect()
    assert Counter(map(tuple, nothing)) == Counter([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, None)])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text")).collect()]
    same(QUERIES["op13_tokenizer_alignment"](spark, SF).collect(), plain(rows)[0])
