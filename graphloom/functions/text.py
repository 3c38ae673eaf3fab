"""Sentences, white space and token counts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.split() sees it, and the characters that end a
# sentence.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
OTHER_SPACE = SPACE.replace(r"\x20", r"\x1f")
# The same behind a class of two parts that most characters are not in, so that these are not held against every range.
_RARE = r"[\x00-\x20\x7f-\uffff&&%s]"
RUN = f"{_RARE % OTHER_SPACE}{_RARE % SPACE}*|\\x20{_RARE % SPACE}+"
ENDINGS = {"full": ".!?。！？", "ascii": ".!?"}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(col: Column | str) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.btrim(_col(col), F.lit(SPACES))


def rstrip(col: Column | str) -> Column:
    return F.rtrim(_col(col), F.lit(SPACES))


def squeeze(col: Column | str) -> Column:
    """Runs of white space become one space; none at the ends.

    Single spaces, by far the most common case, are left alone.
    """
    return F.trim(F.regexp_replace(_col(col), RUN, " "))


def fold(col: Column | str) -> Column:
    """Key form of a text: squeezed and lower-case."""
    return F.lower(squeeze(col))


def strip_markers(col: Column | str) -> Column:
    """Without triple markers, squeezed."""
    col = _col(col)
    bare = F.regexp_replace(col, "</?triplet>|</?subj>|</?obj>", "")
    return squeeze(F.when(F.contains(col, F.lit("<")), bare).otherwise(col))


def split_sentences(col: Column | str, endings: str = "full") -> Column:
    """Sentences: a cut after an ending character that white space follows.

    Blank text gives an empty array; text without an ending is one sentence.
    """
    pieces = F.split(_col(col), f"(?<=[{ENDINGS[endings]}]){SPACE}+")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def pick_sentence(col: Column | str, index: Column | str, chars: int | None = None) -> Column:
    """Sentence number ``index``; without such a sentence the text, or its first ``chars`` characters if given."""
    text = F.coalesce(_col(col), F.lit(""))
    number = F.coalesce(_col(index).try_cast("int"), F.lit(-1))
    start = text if chars is None else F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)
    return F.coalesce(F.when(number >= 0, F.get(split_sentences(text, "ascii"), number)), start)


def token_count(col: Column | str, fn: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Tokens of a text: by the caller's batch function, else words between white space."""
    if fn is not None:
        return F.pandas_udf(fn, "int")(_col(col))
    words = F.split(F.translate(_col(col), SPACES, " " * len(SPACES)), " ")
    return F.size(F.array_remove(words, ""))


def clamp_facts(facts: Column | str, count: int | None = 40, chars: int | None = 280) -> Column:
    """The first ``count`` non-empty facts, each cut to ``chars`` characters with an ellipsis; None: no limit."""
    clean = F.filter(F.transform(_col(facts), lambda f: strip(F.coalesce(f, F.lit("")))), lambda f: f != "")
    first = clean if count is None else F.slice(clean, 1, count)
    if chars is None:
        return first
    short = F.transform(
        first,
        lambda f: F.when(F.length(f) > chars, F.concat(rstrip(F.substring(f, 1, chars)), F.lit("…"))).otherwise(f),
    )
    return short


_END = re.compile(rf"[{ENDINGS['full']}]\s+")


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, sentence)``: spans tile the text, the sentence is stripped."""
    cuts = [0, *[m.end() for m in _END.finditer(text)]]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    found = ((a, b, text[a:b].strip()) for a, b in zip(cuts, cuts[1:]))
    return [span for span in found if span[2]]


def sentence_spans(col: Column | str) -> Column:
    """Sentences with their character offsets, in Arrow batches."""

    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "text": s} for a, b, s in spans_of(t or "")])

    return F.pandas_udf(spans, "array<struct<start:int,end:int,text:string>>")(_col(col))
