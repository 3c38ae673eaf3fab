"""From generated text or relation records to triples, and from triples to graphs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from graphloom.functions import text as T
from graphloom.functions.vectors import let
from graphloom.model import Graphs, as_edges, as_graphs, as_nodes, stable_id
from graphloom.operators.table_functions import linearised
from graphloom.operators.topology import ordinals
from graphloom.operators.windows import WindowConfig, char_windows, sentence_windows
from graphloom.session import cut

# Field names under which relation records keep their parts, in order of
# preference.
HEAD_FIELDS = ["head", "subject", "subj", "source", "entity_1", "entity1", "startEntity", "start_entity", "start"]
TAIL_FIELDS = ["tail", "object", "obj", "target", "entity_2", "entity2", "endEntity", "end_entity", "end"]
RELATION_FIELDS = ["relation", "predicate", "rel", "type", "name"]
ENTITY_FIELDS = ["name", "label", "text", "id"]
CONTAINER_FIELDS = ["relations", "relationship", "relationships", "edges"]

# Triples that leave a task at a time.
PARSED = 20_000

# Provenance written on extracted nodes and edges.
STYLES = {
    "decoded": {"prefix": "entity_", "base": 0, "expandable": "true", "source": "rebel"},
    "records": {"prefix": "ent:", "base": 1, "expandable": "false", "source": None},
}


def parse_triples(df: DataFrame, col: str = "text", score: float = 1.0) -> DataFrame:
    """Triples of linearised text ``<triplet> head <subj> tail <obj> relation …``.

    Every other column of ``df`` is kept; ``pos`` numbers the triples of a text. Texts are read in Arrow batches; what
    goes back at a time is bounded in triples (``PARSED``), not by the length of a text.
    """
    rest = [c for c in df.columns if c != col]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(rest)
            found: list[tuple] = []
            for row, text in enumerate(batch.column(batch.schema.get_field_index(col)).to_pylist()):
                for pos, triple in enumerate(linearised(text) if text is not None else ()):
                    found.append((row, pos, *triple))
                    if len(found) == PARSED:
                        yield _rows(kept, found, score)
                        found = []
            if found:
                yield _rows(kept, found, score)

    schema = StructType([df.schema[c] for c in rest]).add("pos", "integer").add("head", "string").add("relation", "string").add("tail", "string")
    return df.select(*rest, F.col(col).cast("string").alias(col)).mapInArrow(parse, schema.add("score", "double"))


def _rows(kept: pa.RecordBatch, found: list[tuple], score: float) -> pa.RecordBatch:
    """Triples ``(row, pos, head, relation, tail)`` beside the other columns of their rows."""
    row, pos, *parts = zip(*found)
    columns = [c.take(pa.array(row, pa.int64())) for c in kept.columns]
    columns += [pa.array(pos, pa.int32()), *(pa.array(p, pa.string()) for p in parts), pa.array([float(score)] * len(row))]
    return pa.RecordBatch.from_arrays(columns, [*kept.schema.names, "pos", "head", "relation", "tail", "score"])


def valid_triples(triples: DataFrame) -> DataFrame:
    """Triples with three non-empty parts and no marker left in them."""
    parts = [F.col(c) for c in ("head", "relation", "tail")]
    cond = F.lit(True)
    for part in parts:
        cond = cond & (part != "") & ~(F.contains(part, F.lit("<")) & part.rlike("<(subj|obj|triplet)>"))
    return triples.where(cond)


def merge_triples(triples: DataFrame, keys: list[str] = ["doc_id"], squeezed: bool = False) -> DataFrame:
    """One row per triple of a document, whatever its case and spacing.

    The first surface form, window and chunk stay, the score is the highest one and
    ``mentions`` counts the occurrences. ``squeezed``: white space is closed up already, as in the triples of
    :func:`parse_triples`, :func:`relations_to_triples` and the table function.
    """
    parts = ["head", "relation", "tail"]
    triples = triples if squeezed else triples.withColumns({p: T.squeeze(p) for p in parts})
    folded = triples.withColumns({f"__{p}": F.lower(p) for p in parts})
    shown = F.struct(*parts, "chunk_id", "window_idx", "pos")
    merged = folded.groupBy(*keys, *[f"__{p}" for p in parts]).agg(
        F.min_by(shown, F.struct("window_idx", "pos")).alias("first"),
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("mentions"),
    )
    return merged.select(*keys, "first.*", "score", "mentions").select(
        *keys, "window_idx", "pos", *parts, "score", "chunk_id", "mentions"
    )


def mention_chunks(triples: DataFrame, keys: list[str] = ["doc_id"], squeezed: bool = False) -> DataFrame:
    """Chunks in which each (folded) triple occurs, one row per chunk. ``squeezed`` as in :func:`merge_triples`."""
    folded = {p: F.lower(p) if squeezed else T.fold(p) for p in ("head", "relation", "tail")}
    return triples.withColumns(folded).select(*keys, *folded, "chunk_id").distinct()


def _relation_record() -> str:
    fields = dict.fromkeys([*HEAD_FIELDS, *TAIL_FIELDS, *RELATION_FIELDS])
    return "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"


def entity_text(value: Column | str) -> Column:
    """Text of an entity given as a string or as a JSON object; never null."""
    value = F.col(value) if isinstance(value, str) else value

    def named(v: Column) -> Column:
        parsed = F.from_json(v, ",".join(f"{f} string" for f in ENTITY_FIELDS))
        return let(parsed, lambda p: F.coalesce(*[F.nullif(p[f], F.lit("")) for f in ENTITY_FIELDS], F.lit("")))

    def text(v: Column) -> Column:
        return F.when(F.startswith(F.ltrim(v), F.lit("{")), named(v)).otherwise(v)

    return T.squeeze(let(F.coalesce(value, F.lit("")), text))


def relations_to_triples(df: DataFrame, col: str = "json") -> DataFrame:
    """Triples of a JSON object that holds relation records under any of the known names.

    The object is parsed once and its records become triples before they become rows.
    """
    record = _relation_record()
    parsed = F.from_json(col, ",".join(f"{c} {record}" for c in CONTAINER_FIELDS))
    records = let(parsed, lambda p: F.coalesce(*[F.when(F.size(p[c]) > 0, p[c]) for c in CONTAINER_FIELDS]))
    empty = ["", "{}", "[]", "null", "false"]

    def pick(r: Column, names: list[str]) -> Column:
        return entity_text(F.coalesce(*[F.when(~r[n].isin(empty), r[n]) for n in names]))

    def triple(r: Column) -> Column:
        return F.struct(
            pick(r, HEAD_FIELDS).alias("head"), pick(r, RELATION_FIELDS).alias("relation"), pick(r, TAIL_FIELDS).alias("tail")
        )

    full = F.filter(F.transform(records, triple), lambda t: (t["head"] != "") & (t["relation"] != "") & (t["tail"] != ""))
    rest = [c for c in df.columns if c != col]
    rows = df.select(*rest, F.posexplode(full).alias("pos", "t"))
    return rows.select(*rest, "pos", "t.head", "t.relation", "t.tail", F.lit(1.0).alias("score"))


def _place(triples: DataFrame) -> tuple[Column, Column]:
    """Where an end of a triple stands, in an order, and the window of such a ``place``.

    Two 32-bit numbers and a side fit into one number, whose minimum needs no sort.
    """
    if all(triples.schema[c].dataType == IntegerType() for c in ("window_idx", "pos")):
        high, low = F.shiftleft(F.col("window_idx").cast("long"), 32), F.shiftleft(F.col("pos").cast("long"), 1)
        return high + low + F.col("e.side"), F.shiftright("place", 32)
    return F.struct("window_idx", "pos", "e.side"), F.col("place.window_idx")


def _chunks(window: Column) -> tuple[Column, list[Column]]:
    """Coarse chunks and chunks for :func:`ordinals`: of windows, as the triples of one are read from one text by one task."""
    return F.floor(window / 1024), [F.floor(window / 32)]


def assign_entity_ids(triples: DataFrame, prefix: str = "entity_", base: int = 0) -> DataFrame:
    """``(graph_id, label, node_id, ord)``: entities numbered by first appearance, head before tail."""
    ends = F.array(
        F.struct(F.col("head").alias("label"), F.lit(0).alias("side")),
        F.struct(F.col("tail").alias("label"), F.lit(1).alias("side")),
    )
    place, window = _place(triples)
    seen = triples.select("graph_id", "window_idx", "pos", F.explode(ends).alias("e")).select("graph_id", "e.label", place.alias("place"))
    first = seen.groupBy("graph_id", "label").agg(F.min("place").alias("place"))
    numbered = ordinals(first, ["graph_id"], *_chunks(window), [F.col("place")], "ord", base)
    return numbered.select(
        "graph_id", "label", F.concat(F.lit(prefix), F.col("ord").cast("string")).alias("node_id"), "ord"
    )


def triples_to_graph(triples: DataFrame, style: str = "decoded", documents: DataFrame | None = None) -> Graphs:
    """Graphs of merged triples ``(graph_id, window_idx, pos, head, relation, tail, score)``.

    ``decoded`` counts ids from ``entity_0`` and weighs edges by score; ``records`` counts
    from ``ent:1`` and its nodes are not expandable. ``documents(graph_id[, meta])`` adds
    graphs for documents without triples.
    """
    look = STYLES[style]
    # Both are read several times below.
    triples = cut(triples)
    ids = cut(assign_entity_ids(triples, look["prefix"], look["base"]))
    source = look["source"]
    meta = F.create_map(F.lit("source"), F.lit(source), F.lit("original_label"), F.col("label")) if source else F.create_map()
    state = F.create_map(F.lit("expandable"), F.lit(look["expandable"]))
    if style == "decoded":
        state = F.map_concat(state, F.create_map(F.lit("expanded"), F.lit("false")))
    nodes = ids.select(
        "graph_id", "node_id", "ord", "label", F.lit("entity").alias("node_type"), state.alias("state"), meta.alias("meta")
    )
    numbered = ordinals(triples, ["graph_id"], *_chunks(F.col("window_idx")), [F.col("window_idx"), F.col("pos")], "ord")
    key = ids.select("graph_id", "label", "node_id")
    edges = (
        numbered.join(key.select("graph_id", F.col("label").alias("head"), F.col("node_id").alias("s")), ["graph_id", "head"])
        .join(key.select("graph_id", F.col("label").alias("tail"), F.col("node_id").alias("t")), ["graph_id", "tail"])
        .select(
            "graph_id",
            stable_id("graph_id", F.col("ord").cast("string"), length=8).alias("edge_id"),
            "ord",
            F.col("s").alias("source"),
            F.col("t").alias("target"),
            "relation",
            (F.create_map(F.lit("weight"), F.col("score")) if source else F.create_map()).alias("metrics"),
            (F.create_map(F.lit("source"), F.lit(source)) if source else F.create_map()).alias("meta"),
        )
    )
    if documents is None:
        documents = triples.select("graph_id").distinct()
    graphs = documents.withColumn("source", F.lit("bottom_up"))
    return Graphs(as_graphs(graphs), as_nodes(nodes), as_edges(edges))


def extraction_stats(facts: DataFrame, triples: DataFrame, obs_ts: Column, elapsed_ms: Column) -> DataFrame:
    """Graph headers ``(graph_id, meta)`` with fact and triple counts.

    ``facts(graph_id, facts array)`` names every document; one without facts says so.
    """
    counts = triples.groupBy("graph_id").agg(F.count(F.lit(1)).alias("triple_count"))
    rows = facts.select("graph_id", F.size("facts").alias("atomic_facts")).join(counts, "graph_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    # Header entries.
    full = F.create_map(
        F.lit("extractor"), F.lit("itext2kg"),
        F.lit("atomic_facts"), text("atomic_facts"),
        F.lit("obs_timestamp"), F.date_format(obs_ts, "dd-MM-yyyy"),
        F.lit("triple_count"), text("triple_count"),
        F.lit("elapsed_ms"), elapsed_ms.cast("string"),
    )
    empty = F.create_map(F.lit("extractor"), F.lit("itext2kg"), F.lit("reason"), F.lit("empty_input"))
    return rows.select("graph_id", F.when(F.col("atomic_facts") > 0, full).otherwise(empty).alias("meta"))


def extract(
    documents: DataFrame,
    decode: Callable[[pd.Series], pd.Series],
    cfg: WindowConfig = WindowConfig(),
    align_sentences: bool = True,
    count_tokens: Callable[[list[str]], list[int]] | None = None,
) -> Graphs:
    """``documents(graph_id, text)`` → windows → ``decode`` in Arrow batches → merged triples → graphs.

    ``decode`` is the caller's model: a batch of window texts to linearised triples. ``count_tokens`` measures
    sentences in its tokens (words by default); windows of characters have a size of their own.
    """
    texts = documents.select("graph_id", "text")
    if align_sentences:
        windows = sentence_windows(texts, cfg, count_tokens) if count_tokens else sentence_windows(texts, cfg)
    else:
        windows = char_windows(texts, cfg)
    model = F.pandas_udf(decode, "string")
    decoded = windows.select("graph_id", F.col("chunk_id").alias("window_idx"), "chunk_id", model("text").alias("text"))
    # Written once: a repeated task must not ask the model again.
    merged = merge_triples(valid_triples(parse_triples(cut(decoded))), ["graph_id"], squeezed=True)
    return triples_to_graph(merged, "decoded", documents.select("graph_id"))


def extract_records(
    documents: DataFrame,
    relate: Callable[[pd.Series], pd.Series],
    obs_ts: Column,
    max_facts: int | None = None,
    max_chars: int | None = None,
) -> Graphs:
    """``documents(graph_id, text)`` → facts → ``relate`` in Arrow batches → triples → graphs.

    ``relate`` is the caller's model: a batch of fact lists to JSON objects with relation
    records. Documents without facts become empty graphs that say so.
    """
    facts = documents.select(
        "graph_id", T.clamp_facts(T.split_sentences(F.coalesce("text", F.lit(""))), max_facts, max_chars).alias("facts")
    )
    started = time.time()
    model = F.pandas_udf(relate, "string")
    asked = facts.where(F.size("facts") > 0).select("graph_id", model("facts").alias("json"))
    # Written once: a repeated task must not ask the model again.
    triples = relations_to_triples(cut(asked)).withColumn("window_idx", F.lit(0))
    elapsed = F.lit(int((time.time() - started) * 1000))
    return triples_to_graph(triples, "records", extraction_stats(facts, triples, obs_ts, elapsed))
