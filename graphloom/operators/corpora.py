"""Question-answering, fact-checking and relation corpora in one sample shape.

Samples are ``(dataset_id, split, index, query, context, label, evidence)``; label and
evidence are text, containers as JSON. Inputs carry their position as ``idx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import pick_sentence, strip
from graphloom.functions.values import as_text

# Texts of the relation corpus.
RELATION_LABEL = "relation_extraction"
RELATION_QUERY = ("提取文本中的", "关系")
RELATION_DEFAULT = "关键"
PLAIN_QUERY = "从文本中提取实体和关系"

# Field names in order of preference.
FIELDS = {
    "fever": {
        "query": ["claim", "query", "sentence"],
        "label": ["label", "verdict", "gold_label"],
        "context": ["context", "wiki_sentences"],
        "evidence": [],
    },
    "cuad": {
        "query": ["question", "query"],
        "context": ["context", "contract", "text"],
        "label": ["answers", "answer", "label"],
        "evidence": ["answers", "evidence"],
    },
    "scifact": {
        "query": ["claim", "query"],
        "label": ["evidence_label", "label", "verdict"],
        "context": ["abstract", "abstracts", "text"],
        "evidence": ["evidence_sentences", "evidence", "rationale", "sentences"],
    },
    "other": {
        "query": ["query", "question", "claim", "goal", "title"],
        "context": ["context", "text", "document", "abstract"],
        "label": ["label", "answer", "answers"],
        "evidence": ["evidence", "rationale"],
    },
}
WIKI_FIELDS = ["evidence_wiki_url", "evidence_sentence_id", "evidence_id", "evidence_annotation_id"]
PREVIEW_CHARS = 240


def _joined(df: DataFrame, name: str, glue: str) -> Column:
    """A field as text; lists are joined without their nulls."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.ArrayType):
        return as_text(F.col(name), kind.simpleString())
    item = kind.elementType.simpleString()
    return F.array_join(F.transform(name, lambda x: as_text(x, item)), glue)


def _pick(df: DataFrame, names: list[str], glue: str | None) -> Column:
    """First non-null field among ``names`` that the table has, joined by ``glue`` or as JSON."""
    found = [n for n in names if n in df.columns]
    if glue is not None:
        cols = [_joined(df, n, glue) for n in found]
    else:
        cols = [as_text(F.col(n), df.schema[n].dataType.simpleString()) for n in found]
    return F.coalesce(*cols, F.lit(None).cast("string"))


def _filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _field(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def wiki_pages(pages: DataFrame, chars: int | None = None) -> DataFrame:
    """Evidence pages ``(title, text)``: trimmed title, long gaps closed, one row per title; whole, or cut to ``chars``."""
    text = strip(F.regexp_replace("text", "\n{3,}", "\n\n"))
    text = text if chars is None else F.substring(text, 1, chars)
    clean = pages.select(strip("title").alias("title"), text.alias("text")).where("title <> ''")
    return clean.groupBy("title").agg(F.max("text").alias("text"))


def corpus_documents(corpus: DataFrame) -> DataFrame:
    """Abstracts by integer id; rows without one are skipped, the last of equal ids wins by ``idx``."""
    rows = corpus.withColumn("doc_id", F.col("doc_id").try_cast("int")).where("doc_id IS NOT NULL")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("title", "abstract"), F.col("idx")).alias("d"))
    return last.select("doc_id", "d.title", "d.abstract")


def _docred(df: DataFrame) -> dict[str, Column]:
    first = F.get("labels", F.lit(0))
    named = F.concat(F.lit(RELATION_QUERY[0]), F.coalesce(first["r"], F.lit(RELATION_DEFAULT)), F.lit(RELATION_QUERY[1]))
    query = F.coalesce(
        F.col("title"),
        F.substring(_field(df, "abstract", "string"), 1, 200),
        F.when(F.size("labels") > 0, named),
        F.lit(PLAIN_QUERY),
    )
    context = F.array_join(F.transform("sents", lambda s: F.array_join(s, " ")), " ")
    return {
        "query": query,
        "context": F.coalesce(context, F.lit("")),
        "label": F.lit(RELATION_LABEL),
        "evidence": F.to_json(F.struct("sents", "vertexSet", "labels")),
    }


def _fever(df: DataFrame, pages: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    names = FIELDS["fever"]
    query, label = _pick(df, names["query"], " "), _pick(df, names["label"], None)
    given = _pick(df, names["context"], "\n")
    title = strip(_field(df, "evidence_wiki_url", "string"))
    pointers = [(F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in WIKI_FIELDS]
    rows = df.withColumns({"__title": title})
    if pages is None:
        rows = rows.withColumn("__page", F.lit(None).cast("string"))
    else:
        # rows without a page would meet in one task: each gets a key that no trimmed title is like
        side = pages.select(F.col("title").alias("__key"), F.col("text").alias("__page"))
        rows = rows.withColumn("__key", F.coalesce(F.nullif("__title", F.lit("")), F.concat(F.lit(" "), F.col("idx").cast("string")))).join(side, "__key", "left")
    looked_up = F.nullif(given, F.lit("")).isNull() & F.col("__page").isNotNull()
    sentence = F.when(looked_up, pick_sentence("__page", _field(df, "evidence_sentence_id", "string")))
    keep = {"ignoreNullFields": "false"}
    evidence = F.when(sentence.isNull(), F.to_json(F.struct(*pointers), keep)).otherwise(
        F.to_json(F.struct(*pointers, sentence.alias("evidence_text")), keep)
    )
    context = _filled(given, sentence, F.when(looked_up, F.col("__page")), query)
    return rows, {"query": query, "context": context, "label": label, "evidence": evidence}


def _scifact(df: DataFrame, corpus: DataFrame | None, resolve_ids: bool) -> tuple[DataFrame, dict[str, Column]]:
    names = FIELDS["scifact"]
    query, label = _pick(df, names["query"], " "), _pick(df, names["label"], None)
    abstract = _pick(df, names["context"], "\n")
    quoted = _pick(df, names["evidence"], "\n")
    evidence = _pick(df, names["evidence"], None)
    cited = F.get("cited_doc_ids", F.lit(0)) if "cited_doc_ids" in df.columns else F.lit(None)
    # ids may be text, also empty or no number: then the first cited one counts
    own = _field(df, "evidence_doc_id", "string").try_cast("int")
    doc_id = F.when(own > 0, own).otherwise(cited.try_cast("int"))
    rows = df.withColumn("__doc", F.when(doc_id > 0, doc_id))
    if corpus is None:
        rows = rows.withColumns({"__title": F.lit(None).cast("string"), "__lines": F.lit(None).cast("array<string>")})
    else:
        # rows that cite nothing are spread over keys below 1, which no row cites
        side = corpus.where("doc_id > 0").select(F.col("doc_id").cast("long").alias("__key"), F.col("title").alias("__title"), F.col("abstract").alias("__lines"))
        none = -F.pmod(F.xxhash64("idx"), F.lit(1 << 40))
        rows = rows.withColumn("__key", F.coalesce(F.col("__doc").cast("long"), none)).join(side, "__key", "left")
    body = F.array_join("__lines", "\n")
    with_title = strip(F.concat(F.col("__title"), F.lit("\n\n"), F.coalesce(body, F.lit(""))))
    document = F.when(F.nullif("__title", F.lit("")).isNull(), body).otherwise(with_title)
    if not resolve_ids:
        context = _filled(abstract, quoted, document, query)
    else:
        # Sentence numbers are no text: they point into the cited abstract.
        context = _filled(abstract, document, query)
        picked = F.transform("evidence_sentences", lambda i: F.when(i >= 0, F.get(F.col("__lines"), i)))
        texts = F.filter(picked, lambda s: s.isNotNull())
        both = F.to_json(F.struct(F.col("evidence_sentences").alias("sentence_ids"), texts.alias("evidence_text")))
        evidence = F.when(F.size(texts) > 0, both).otherwise(evidence)
    return rows, {"query": query, "context": context, "label": label, "evidence": evidence}


def normalize(
    df: DataFrame,
    dataset_id: str,
    split: str,
    side: DataFrame | None = None,
    include_raw: bool = False,
    resolve_ids: bool = False,
) -> DataFrame:
    """Samples of one corpus split.

    ``side`` is the page table of ``fever`` (:func:`wiki_pages`) or the abstracts of
    ``scifact`` (:func:`corpus_documents`). With ``resolve_ids`` integer evidence of
    ``scifact`` is looked up in the cited abstract instead of standing in for the context.
    """
    if dataset_id == "docred":
        rows, out = df, _docred(df)
    elif dataset_id == "fever":
        rows, out = _fever(df, side)
    elif dataset_id == "scifact":
        rows, out = _scifact(df, side, resolve_ids)
    else:
        names = FIELDS.get(dataset_id, FIELDS["other"])
        glue = {"query": " ", "context": "\n", "label": None, "evidence": None}
        rows, out = df, {part: _pick(df, names[part], glue[part]) for part in glue}
    raw = [F.to_json(F.struct(*[c for c in df.columns if c != "idx"])).alias("raw")] if include_raw else []
    return rows.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(split).alias("split"),
        F.col("idx").alias("index"),
        *[out[part].alias(part) for part in ("query", "context", "label", "evidence")],
        *raw,
    )


def cap_context(samples: DataFrame, max_chars: int = 20_000) -> DataFrame:
    """Context for display: 0 leaves none, a longer one is cut and marked; the total stays known."""
    total = F.length("context")
    if max_chars == 0:
        shown, cut = F.when(total.isNotNull(), F.lit("")), F.when(total.isNotNull(), F.lit(True))
    else:
        cut = total > max_chars
        shown = F.when(cut, F.concat(F.substring("context", 1, max_chars), F.lit("..."))).otherwise(F.col("context"))
    return samples.withColumns({"context": shown, "context_truncated": cut, "context_total_chars": total})


def _preview(text: Column) -> Column:
    long = F.length(text) > PREVIEW_CHARS
    return F.when(long, F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("..."))).otherwise(text)


def preview(samples: DataFrame) -> DataFrame:
    """``(index, query, context_preview, context_length, label)`` of normalised samples."""
    context = F.coalesce("context", F.lit(""))
    return samples.select(
        "index",
        F.coalesce("query", F.lit("")).alias("query"),
        _preview(context).alias("context_preview"),
        F.length(context).alias("context_length"),
        "label",
    )


def sample_counts(df: DataFrame) -> DataFrame:
    """Sentences, entities and relations of each relation-corpus sample."""
    size = lambda c: F.size(F.coalesce(c, F.array()))
    return df.select(
        F.col("idx").alias("index"),
        size("sents").alias("sentence_count"),
        size("vertexSet").alias("entity_count"),
        size("labels").alias("relation_count"),
    )


def docred_preview(df: DataFrame) -> DataFrame:
    """Preview from the first two sentences; the full text is never joined for it.

    ``preview_length`` is the length of those two, ``context_length`` that of the whole text.
    """
    two = F.coalesce(F.array_join(F.transform(F.slice("sents", 1, 2), lambda s: F.array_join(s, " ")), " "), F.lit(""))
    words = F.aggregate(
        F.coalesce("sents", F.array()),
        F.lit(-1),
        lambda n, s: n + F.length(F.array_join(s, " ")) + 1,
    )
    size = lambda c: F.size(F.coalesce(c, F.array()))
    return df.select(
        F.col("idx").alias("index"),
        _docred(df)["query"].alias("query"),
        _preview(two).alias("context_preview"),
        F.length(two).alias("preview_length"),
        F.greatest(words, F.lit(0)).alias("context_length"),
        F.lit(RELATION_LABEL).alias("label"),
        size("sents").alias("sentence_count"),
        size("vertexSet").alias("entity_count"),
        size("labels").alias("relation_count"),
    )


def sample_page(df: DataFrame, page: int = 1, page_size: int = 20, index: str = "index") -> DataFrame:
    """One page of samples as a range on the stored position, which the scan can prune."""
    return df.where(F.col(index).between(*page_range(page, page_size)))


def page_range(page: int, page_size: int) -> tuple[int, int]:
    """First and last position of a page."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page starts at 1 and page_size lies between 1 and 100")
    return (page - 1) * page_size, page * page_size - 1


def sample_at(df: DataFrame, position: int, index: str = "index") -> DataFrame:
    """The sample at a position; a position beyond the end gives no row."""
    if position < 0:
        raise IndexError("index must not be negative")
    return df.where(F.col(index) == position)


def split_totals(samples: DataFrame, page_size: int = 20) -> DataFrame:
    """Samples and pages per corpus split."""
    totals = samples.groupBy("dataset_id", "split").agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("total_pages", F.ceil(F.col("total") / page_size))


def with_provenance(experiments: DataFrame, samples: DataFrame) -> DataFrame:
    """Experiments beside the sample they started from."""
    picked = samples.select(
        F.col("dataset_id"), F.col("split").alias("dataset_split"), F.col("index").alias("dataset_index"), "query", "context"
    )
    return experiments.join(picked, ["dataset_id", "dataset_split", "dataset_index"], "left")
