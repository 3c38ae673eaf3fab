"""Queries on generator answers, prompts and corpora."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog import query
from catalog.graphs import WIDE
from catalog.tables import (
    DOCRED,
    FEVER,
    RESPONSES,
    SCIFACT,
    SENTENCES,
    SUPPLY,
    docred_rows,
    fever_rows,
    responses,
    scifact_rows,
    supply_graph,
    table,
)
from graphloom.functions import slots
from graphloom.functions.text import split_sentences
from graphloom.operators import corpora, expansion, halting
from graphloom.session import checkpoint_dir
from graphloom.sources import arrays, datasets, splits


@query("salvage_json", f"WITH {RESPONSES} SELECT graph_id, j FROM salvaged")
def salvage_json(spark, sf):
    return responses(spark, sf).select("graph_id", expansion.salvage_json("response").alias("j"))


@query(
    "response_nodes",
    f"WITH {RESPONSES} SELECT graph_id, node_id, ord, label, node_type, description, 'gpt' AS origin, 'true' AS expandable FROM r_nodes",
)
def response_nodes(spark, sf):
    return expansion.responses_to_graphs(responses(spark, sf)).nodes.select(
        "graph_id",
        "node_id",
        "ord",
        "label",
        "node_type",
        slots.meta("description").alias("description"),
        slots.meta("source").alias("origin"),
        slots.state("expandable").alias("expandable"),
    )


@query(
    "response_edges",
    f"""WITH {RESPONSES} SELECT graph_id, source, target, relation FROM r_edges e
WHERE EXISTS (SELECT 1 FROM r_nodes n WHERE n.graph_id = e.graph_id AND n.node_id IN (e.source, e.target))""",
)
def response_edges(spark, sf):
    return expansion.responses_to_graphs(responses(spark, sf)).edges.select("graph_id", "source", "target", "relation")


@query(
    "response_headers",
    f"WITH {RESPONSES} SELECT graph_id, 'gpt_expander' AS source, j->>'parent_node_id' AS parent, j->>'reason' AS reason FROM salvaged",
)
def response_headers(spark, sf):
    return expansion.responses_to_graphs(responses(spark, sf)).graphs.select(
        "graph_id", "source", slots.meta("parent_node_id").alias("parent"), slots.meta("reason").alias("reason")
    )


@query(
    "expansion_frontier",
    f"""WITH {SUPPLY} SELECT graph_id, node_id FROM (
  SELECT n.graph_id, n.node_id, row_number() OVER (PARTITION BY n.graph_id ORDER BY degree DESC, ord) AS r
  FROM nodes n JOIN degrees USING (graph_id, node_id)) WHERE r = 1""",
)
def expansion_frontier(spark, sf):
    return expansion.expansion_frontier(halting.score_nodes(supply_graph(spark, sf), limits=WIDE))


CONTEXT = f"""{SUPPLY},
n AS (SELECT graph_id, list(to_json({{'id': node_id, 'label': label, 'type': node_type, 'description': '',
       'ablation_value': 0.0::DOUBLE, 'expanded': false, 'expandable': true}}) ORDER BY ord) AS nodes FROM nodes GROUP BY ALL),
e AS (SELECT graph_id, list(to_json({{'source': source, 'target': target, 'relation': relation}}) ORDER BY ord, source, target, relation) AS edges
      FROM edges GROUP BY ALL)
SELECT coalesce(n.graph_id, e.graph_id) AS graph_id,
  '{{"goal":"","nodes":[' || coalesce(array_to_string(nodes, ','), '') || '],"edges":[' || coalesce(array_to_string(edges, ','), '') || ']}}' AS context
FROM n FULL JOIN e ON n.graph_id = e.graph_id"""


@query("graph_context", f"WITH {CONTEXT}")
def graph_context(spark, sf):
    return expansion.graph_context(supply_graph(spark, sf))


@query(
    "graph_expansion_prompts",
    f"""WITH {CONTEXT.replace("SELECT coalesce(n.graph_id", ", c AS (SELECT coalesce(n.graph_id", 1)})
SELECT graph_id, E'This is the current graph as JSON:\\n' || context
  || E'\\nChoose the one node most worth expanding (high ablation_value, not expanded, expandable) and design about 4 nodes below it, each linked to it by an edge.\\n'
  || 'Answer with JSON only: {{"nodes": [{{"id", "label", "description", "type": system | concept | entity}}], "edges": [{{"source", "target", "relation"}}], "parent_node_id", "reason"}}' AS prompt
FROM c""",
)
def graph_expansion_prompts(spark, sf):
    """What a model is asked for the next nodes of each graph."""
    return expansion.graph_prompts(supply_graph(spark, sf), 4)


@query(
    "expansion_prompts",
    r"""SELECT CAST(doc_id AS VARCHAR) AS graph_id,
  E'Break the following goal down into a layered graph of subsystems and modules.\nGoal: ' || text
  || E'\nUse at most 8 nodes, give each a clear label and a description, and name the relations between them.\n'
  || 'Answer with JSON only: {"nodes": [{"id", "label", "description", "type": system | concept | entity}], "edges": [{"source", "target", "relation"}]}' AS prompt
FROM documents""",
)
def expansion_prompts(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("graph_id"), "text")
    return docs.select("graph_id", expansion.goal_prompt("text", 8).alias("prompt"))


@query(
    "expand_goals",
    r"""WITH p AS (SELECT CAST(item_id AS VARCHAR) AS graph_id, text || E'\nUse at most 10 nodes, give each a clear label and a description, and name the relations between them.\n'
  || 'Answer with JSON only: {"nodes": [{"id", "label", "description", "type": system | concept | entity}], "edges": [{"source", "target", "relation"}]}' AS prompt FROM benchmark),
w AS (SELECT graph_id, regexp_split_to_array(trim(prompt, E' \n\t\r'), '\s+') AS words FROM p),
i AS (SELECT graph_id, unnest(words) AS label, generate_subscripts(words, 1) AS i FROM w),
f AS (SELECT graph_id, label, min(i) AS i FROM i GROUP BY ALL)
SELECT graph_id, 'n' || (row_number() OVER (PARTITION BY graph_id ORDER BY i) - 1) AS node_id, label FROM f""",
)
def expand_goals(spark, sf):
    """Goals through a stand-in generator that answers with the words of the goal."""

    def generate(prompts):
        import json

        def answer(prompt):
            words = prompt.split("Goal: ", 1)[1].split()
            nodes = [{"id": f"n{i}", "label": w} for i, w in enumerate(dict.fromkeys(words))]
            edges = [{"source": "n0", "target": n["id"], "relation": "contains"} for n in nodes[1:]]
            return json.dumps({"nodes": nodes, "edges": edges})

        return prompts.map(answer)

    goals = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("graph_id"), F.col("text").alias("goal"))
    return expansion.expand_goals(goals, generate).nodes.select("graph_id", "node_id", "label")


@query("normalize_fever", f"WITH {FEVER} SELECT * FROM fever_out")
def normalize_fever(spark, sf):
    return _fever(spark, sf)


def _fever(spark, sf):
    rows, pages = fever_rows(spark, sf)
    return corpora.normalize(rows, "fever", "train", corpora.wiki_pages(pages))


@query("wiki_pages", f"WITH {FEVER} SELECT title, page AS text FROM pages_")
def wiki_pages(spark, sf):
    return corpora.wiki_pages(fever_rows(spark, sf)[1])


@query(
    "normalize_docred",
    f"""WITH {DOCRED} SELECT 'docred' AS dataset_id, 'dev' AS split, idx AS "index", query, array_to_string(p, ' ') AS context, 'relation_extraction' AS label,
to_json({{'sents': sents, 'vertexSet': "vertexSet", 'labels': labels}})::VARCHAR AS evidence FROM docred""",
)
def normalize_docred(spark, sf):
    return corpora.normalize(docred_rows(spark, sf), "docred", "dev")


@query(
    "docred_preview",
    f"""WITH {DOCRED}, two AS (SELECT *, array_to_string(p[1:2], ' ') AS t FROM docred)
SELECT idx AS "index", query, CASE WHEN length(t) > 240 THEN left(t, 240) || '...' ELSE t END AS context_preview, CAST(length(t) AS INTEGER) AS preview_length,
  CAST(length(array_to_string(p, ' ')) AS INTEGER) AS context_length, 'relation_extraction' AS label, CAST(len(p) AS INTEGER) AS sentence_count,
  CAST(len(p) AS INTEGER) AS entity_count, CAST(len(labels) AS INTEGER) AS relation_count FROM two""",
)
def docred_preview(spark, sf):
    return corpora.docred_preview(docred_rows(spark, sf))


@query(
    "sample_counts",
    f"""WITH {DOCRED} SELECT idx AS "index", CAST(len(sents) AS INTEGER) AS sentence_count, CAST(len("vertexSet") AS INTEGER) AS entity_count,
CAST(len(labels) AS INTEGER) AS relation_count FROM docred""",
)
def sample_counts(spark, sf):
    return corpora.sample_counts(docred_rows(spark, sf))


@query(
    "normalize_scifact",
    f"""WITH {SCIFACT} SELECT 'scifact' AS dataset_id, 'train' AS split, idx AS "index", claim AS query, label,
  coalesce(CASE WHEN len(ev) > 0 THEN array_to_string(ev, chr(10)) END, nullif(doc, ''), claim) AS context, to_json(ev)::VARCHAR AS evidence FROM scifact""",
)
def normalize_scifact(spark, sf):
    claims, corpus = scifact_rows(spark, sf)
    return corpora.normalize(claims, "scifact", "train", corpora.corpus_documents(corpus))


@query(
    "normalize_scifact_resolved",
    f"""WITH {SCIFACT}, t AS (SELECT *, list_filter(list_transform(ev, lambda i: lines[i + 1]), lambda s: s IS NOT NULL) AS texts FROM scifact)
SELECT 'scifact' AS dataset_id, 'train' AS split, idx AS "index", claim AS query, label, coalesce(nullif(doc, ''), claim) AS context,
  CASE WHEN len(texts) > 0 THEN to_json({{'sentence_ids': ev, 'evidence_text': texts}}) ELSE to_json(ev) END::VARCHAR AS evidence FROM t""",
)
def normalize_scifact_resolved(spark, sf):
    claims, corpus = scifact_rows(spark, sf)
    return corpora.normalize(claims, "scifact", "train", corpora.corpus_documents(corpus), resolve_ids=True)


@query("corpus_documents", f"WITH {SCIFACT} SELECT CAST(doc_id AS INTEGER) AS doc_id, title, CAST(len(lines) AS INTEGER) AS lines FROM corpus_")
def corpus_documents(spark, sf):
    docs = corpora.corpus_documents(scifact_rows(spark, sf)[1])
    return docs.select("doc_id", "title", F.size("abstract").alias("lines"))


@query(
    "normalize_cuad",
    """SELECT 'cuad' AS dataset_id, 'test' AS split, conv_id * 100 + turn AS "index", c.text AS query, d.text AS context,
to_json({'text': [role], 'answer_start': [turn]})::VARCHAR AS label, to_json({'text': [role], 'answer_start': [turn]})::VARCHAR AS evidence
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id""",
)
def normalize_cuad(spark, sf):
    turns = table(spark, sf, "conversations").withColumnRenamed("text", "question")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    rows = turns.join(docs, "conv_id", "left").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("idx"),
        "question",
        "context",
        F.struct(F.array("role").alias("text"), F.array("turn").alias("answer_start")).alias("answers"),
    )
    return corpora.normalize(rows, "cuad", "test")


@query(
    "normalize_other",
    f"""WITH {SENTENCES}, c AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS context FROM sent GROUP BY doc_id)
SELECT 'own' AS dataset_id, 'train' AS split, doc_id AS "index", lang || ' ' || source AS query, context, CAST(n_chars AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS evidence
FROM documents LEFT JOIN c USING (doc_id)""",
)
def normalize_other(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"),
        F.array("lang", F.lit(None), "source").alias("goal"),
        split_sentences("text").alias("document"),
        F.col("n_chars").alias("answer"),
    )
    return corpora.normalize(rows, "own", "train")


@query(
    "cap_context",
    f"""WITH {FEVER} SELECT "index", CASE WHEN length(context) > 500 THEN left(context, 500) || '...' ELSE context END AS context,
length(context) > 500 AS context_truncated, CAST(length(context) AS INTEGER) AS context_total_chars FROM fever_out""",
)
def cap_context(spark, sf):
    return corpora.cap_context(_fever(spark, sf), 500).select("index", "context", "context_truncated", "context_total_chars")


@query(
    "sample_preview",
    f"""WITH {FEVER} SELECT "index", query, CASE WHEN length(context) > 240 THEN left(context, 240) || '...' ELSE context END AS context_preview,
CAST(length(context) AS INTEGER) AS context_length, label FROM fever_out""",
)
def sample_preview(spark, sf):
    return corpora.preview(_fever(spark, sf))


@query("sample_page", f'WITH {FEVER} SELECT "index", query, label FROM fever_out WHERE "index" BETWEEN 40 AND 59')
def sample_page(spark, sf):
    rows, pages = fever_rows(spark, sf)
    page = corpora.sample_page(rows, 3, 20, "idx")
    return corpora.normalize(page, "fever", "train", corpora.wiki_pages(pages)).select("index", "query", "label")


@query("sample_at", 'SELECT doc_id AS "index", text AS query FROM documents WHERE doc_id = 7')
def sample_at(spark, sf):
    rows, _ = fever_rows(spark, sf)
    return corpora.normalize(corpora.sample_at(rows, 7, "idx"), "fever", "train").select("index", "query")


@query(
    "split_totals",
    """SELECT 'fever' AS dataset_id, 'train' AS split, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM documents
UNION ALL SELECT 'scifact', 'train', count(*), CAST(ceil(count(*) / 20.0) AS BIGINT) FROM conversations""",
)
def split_totals(spark, sf):
    claims, _ = scifact_rows(spark, sf)
    samples = corpora.normalize(fever_rows(spark, sf)[0], "fever", "train").unionByName(
        corpora.normalize(claims, "scifact", "train")
    )
    return corpora.split_totals(samples)


@query(
    "experiment_provenance",
    f"""WITH {FEVER}, u AS (SELECT user_id, count(*) AS events FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS experiment_id, f.query FROM u LEFT JOIN fever_out f ON f."index" = user_id""",
)
def experiment_provenance(spark, sf):
    users = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    experiments = users.select(
        F.col("user_id").cast("string").alias("experiment_id"),
        F.lit("fever").alias("dataset_id"),
        F.lit("train").alias("dataset_split"),
        F.col("user_id").alias("dataset_index"),
    )
    return corpora.with_provenance(experiments, _fever(spark, sf)).select("experiment_id", "query")


def _array_files(spark, sf):
    """Documents as relation samples, 512 a file, each file one JSON array; their folder."""
    folder = f"{checkpoint_dir(spark)}/arrays-{uuid.uuid4().hex}"
    words = F.split(F.coalesce("text", F.lit("")), " ")
    labels = F.array(F.struct(F.col("source").alias("r"), F.lit(0).alias("h"), F.lit(1).alias("t"), F.array(F.lit(0)).alias("evidence")))
    vertex = F.array(F.array(F.struct(F.col("lang").alias("name"), F.lit('{"}\\').alias("type"), F.lit(0).alias("sent_id"), F.array(F.lit(0)).alias("pos"))))
    sample = F.to_json(F.struct(F.concat("doc_id", F.lit(": {")).alias("title"), F.array(words).alias("sents"), vertex.alias("vertexSet"), labels.alias("labels")))
    rows = table(spark, sf, "documents").withColumns({"part": F.floor(F.col("doc_id") / 512), "sample": sample})
    by_id = Window.partitionBy("part").orderBy("doc_id")
    opened = F.when(F.row_number().over(by_id) == 1, F.lit("[")).otherwise(F.lit(","))
    ended = F.when(F.lead("doc_id").over(by_id).isNull(), F.lit("]")).otherwise(F.lit(""))
    lines = rows.select("part", "doc_id", F.concat(opened, "sample", ended).alias("value"))
    lines.sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(folder)
    return folder


@query(
    "read_array_files",
    """SELECT doc_id // 512 AS part, doc_id || ': {' AS title, row_number() OVER (PARTITION BY doc_id // 512 ORDER BY doc_id) - 1 AS idx,
  coalesce(text, '') AS text, lang, '{"}\\' AS entity_type, source FROM documents""",
)
def read_array_files(spark, sf):
    """Array files, split and put together again, with the position of each sample."""
    rows = arrays.read_array(spark, _array_files(spark, sf), datasets.DOCRED_SAMPLE)
    entity = F.col("vertexSet")[0][0]
    return rows.select(
        F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "title", "idx", F.array_join(F.col("sents")[0], " ").alias("text"),
        entity["name"].alias("lang"), entity["type"].alias("entity_type"), F.col("labels")[0]["r"].alias("source"),
    )


def _stored(spark, sf, rows, dataset_id="fever", split="train"):
    """``rows`` as a stored split of 64 rows a file; its root."""
    root = f"{checkpoint_dir(spark)}/corpora-{uuid.uuid4().hex}"
    splits.store_split(rows, root, dataset_id, split, file_rows=64)
    return root


@query("stored_sample_page", f'WITH {FEVER} SELECT "index", query, label FROM fever_out WHERE "index" BETWEEN 40 AND 59')
def stored_sample_page(spark, sf):
    """A page of the stored form of the corpus; what lies on other pages is not opened."""
    rows, pages = fever_rows(spark, sf)
    page = splits.read_page(spark, _stored(spark, sf, rows), "fever", "train", 3, 20)
    return corpora.normalize(page, "fever", "train", corpora.wiki_pages(pages)).select("index", "query", "label")


@query(
    "stored_split_totals",
    """SELECT 'fever' AS dataset_id, 'train' AS split, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM documents""",
)
def stored_split_totals(spark, sf):
    """Totals of stored splits, found by their folders and read from their bounds."""
    return splits.totals(spark, _stored(spark, sf, fever_rows(spark, sf)[0]), ["fever", "cuad"])


@query("stored_split_rows", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def stored_split_rows(spark, sf):
    """Positions given in file order while a corpus is stored; the rows of the table lie in the order of their ids."""
    root = _stored(spark, sf, spark.read.parquet(f"{sf}/documents.parquet"), "cuad", "test")
    return datasets.read_split(spark, root, "cuad", "test").select("doc_id", "idx")


@query(
    "corpus_catalogue",
    """SELECT dataset_id, split FROM (VALUES ('docred', 'train_annotated'), ('docred', 'train_distant'), ('docred', 'dev'), ('docred', 'test'),
  ('fever', 'train'), ('cuad', 'train'), ('cuad', 'test'), ('scifact', 'train'), ('scifact', 'validation'), ('scifact', 'test')) v(dataset_id, split)""",
)
def corpus_catalogue(spark, sf):
    """The corpora with their splits: fixed ones, a stored one, usual names for the others."""
    root = _stored(spark, sf, fever_rows(spark, sf)[0])
    known = datasets.catalogue(spark).select("dataset_id")
    found = [datasets.list_splits(spark, root, d).select(F.lit(d).alias("dataset_id"), "split") for d in ("docred", "fever", "cuad", "scifact")]
    return known.join(reduce(DataFrame.unionByName, found), "dataset_id")
