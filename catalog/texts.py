"""Queries on sentences, windows, triples and the graphs made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import DECODED, SENTENCES, decoded_text, relation_records, table
from graphloom.functions import slots
from graphloom.functions import text as T
from graphloom.operators import table_functions
from graphloom.operators import triples as TR
from graphloom.operators.windows import WindowConfig, char_windows, sentence_windows


@query("split_sentences", f"WITH {SENTENCES} SELECT doc_id, CAST(i AS INTEGER) AS i, s FROM sent")
def split_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_sentences("text")).alias("i", "s"))


@query(
    "sentence_spans",
    r"""WITH pieces AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?。！？]\s+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
placed AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM pieces)
SELECT doc_id, CAST(e - length(piece) AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", trim(piece, E' \n') AS text
FROM placed WHERE trim(piece, E' \n') <> ''""",
)
def sentence_spans(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(T.sentence_spans("text")).alias("s")).select("doc_id", "s.*")


@query(
    "pick_sentence",
    r"""WITH parts AS (SELECT doc_id, text, list_filter(list_transform(
  string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \n')), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, CASE WHEN doc_id % 50 < len(p) THEN p[doc_id % 50 + 1] ELSE text END AS sentence FROM parts""",
)
def pick_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.pick_sentence("text", F.col("doc_id") % 50).alias("sentence"))


@query(
    "token_count",
    r"SELECT doc_id, CAST(len(regexp_split_to_array(trim(text, E' \n'), '\s+')) AS INTEGER) AS tokens FROM documents",
)
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count("text").alias("tokens"))


@query(
    "fold_text",
    r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS folded FROM documents",
)
def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold("text").alias("folded"))


@query(
    "strip_markers",
    rf"WITH {DECODED} SELECT graph_id, window_idx, trim(regexp_replace(regexp_replace(d, '</?triplet>|</?subj>|</?obj>', '', 'g'), '\s+', ' ', 'g')) AS text FROM decoded",
)
def strip_markers(spark, sf):
    bare = F.regexp_replace("text", "</?s>", "")
    return decoded_text(spark, sf).select("graph_id", "window_idx", T.strip_markers(bare).alias("text"))


@query(
    "clamp_facts",
    f"""WITH {SENTENCES}
SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN length(s) > 80 THEN rtrim(left(s, 80), E' \\n') || '…' ELSE s END AS fact FROM sent WHERE i < 10""",
)
def clamp_facts(spark, sf):
    facts = T.clamp_facts(T.split_sentences("text"), 10, 80)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(facts).alias("i", "fact"))


@query(
    "char_windows",
    r"""WITH sized AS (SELECT doc_id, text, length(text) AS n, len(regexp_split_to_array(trim(text, E' \n'), '\s+')) AS tokens FROM documents),
w AS (
  SELECT doc_id, 0 AS s, n AS e, text FROM sized WHERE tokens <= 100
  UNION ALL
  SELECT doc_id, s, least(s + 400, n), substr(text, s + 1, 400) FROM (
    SELECT doc_id, text, n, unnest(range(0, CAST(ceil(greatest(n - 400, 0) / 320.0) AS BIGINT) * 320 + 1, 320)) AS s FROM sized WHERE tokens > 100))
SELECT doc_id, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", text, CAST(s / 320 AS INTEGER) AS chunk_id FROM w""",
)
def char_windows_(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return char_windows(docs, WindowConfig(window_size=100, overlap=20))


SENTENCE_WINDOWS = r"""
pieces AS (
  SELECT doc_id, text, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM (
    SELECT doc_id, text, string_split(regexp_replace(text, '([.!?。！？]\s+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
placed AS (
  SELECT doc_id, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e,
         len(regexp_split_to_array(trim(piece, E' \n'), '\s+')) AS t FROM pieces),
s AS (
  SELECT doc_id, row_number() OVER w - 1 AS i, e - length(piece) AS st, e AS en, t, sum(t) OVER w - t AS p,
         count(*) OVER (PARTITION BY doc_id) AS n, sum(t) OVER (PARTITION BY doc_id) AS total
  FROM placed WHERE trim(piece, E' \n') <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
back AS (
  SELECT a.doc_id, a.i, min(b.i) AS tail, min(b.p) AS tail_p FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 20 AND a.i
  WHERE a.p - b.p <= 20 GROUP BY ALL),
steps AS (SELECT s.*, tail, tail_p FROM s JOIN back USING (doc_id, i) WHERE total > 100),
replay(doc_id, i, n, first, first_p, held, a, b) AS (
  SELECT doc_id, i, n, i, p, 0::HUGEINT, NULL::BIGINT, NULL::BIGINT FROM steps WHERE i = 0
  UNION ALL
  SELECT doc_id, i + 1, n,
         CASE WHEN t > 100 THEN i + 1 WHEN closes THEN greatest(first, tail) ELSE first END,
         CASE WHEN t > 100 THEN p + t WHEN closes THEN greatest(first_p, tail_p) ELSE first_p END,
         CASE WHEN t > 100 THEN 0 WHEN closes THEN p - greatest(first_p, tail_p) + t ELSE held + t END,
         CASE WHEN closes THEN first END, CASE WHEN closes THEN i END
  FROM (SELECT s.*, r.first, r.first_p, r.held, r.first < s.i AND r.held + s.t > 100 AS closes
        FROM replay r JOIN steps s ON s.doc_id = r.doc_id AND s.i = r.i)),
bounds AS (
  SELECT doc_id, a, b FROM replay WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, first, n FROM replay WHERE i = n AND first < n
  UNION ALL SELECT doc_id, i, i + 1 FROM steps WHERE t > 100),
windows AS (
  SELECT doc_id, x.st AS ws, y.en AS we, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS chunk_id
  FROM bounds JOIN s x USING (doc_id) JOIN s y USING (doc_id) WHERE x.i = a AND y.i = b - 1
  UNION ALL SELECT doc_id, 0, length(text), 0 FROM documents WHERE doc_id IN (SELECT doc_id FROM s WHERE total <= 100)),
sentence_windows AS (
  SELECT doc_id, CAST(ws AS INTEGER) AS "start", CAST(we AS INTEGER) AS "end", substr(text, CAST(ws AS BIGINT) + 1, CAST(we - ws AS BIGINT)) AS text,
         CAST(chunk_id AS INTEGER) AS chunk_id FROM windows JOIN documents USING (doc_id))"""


@query("sentence_windows", f"WITH RECURSIVE {SENTENCE_WINDOWS} SELECT * FROM sentence_windows")
def sentence_windows_(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sentence_windows(docs, WindowConfig(window_size=100, overlap=20))


@query(
    "parse_triples",
    f"WITH {DECODED} SELECT graph_id, window_idx, pos, head, relation, tail FROM triples",
)
def parse_triples(spark, sf):
    return TR.parse_triples(decoded_text(spark, sf)).select("graph_id", "window_idx", "pos", "head", "relation", "tail")


@query(
    "valid_triples",
    f"WITH {DECODED} SELECT graph_id, count(*) AS triples FROM triples WHERE NOT regexp_matches(head || relation || tail, '<(subj|obj|triplet)>') GROUP BY graph_id",
)
def valid_triples(spark, sf):
    return TR.valid_triples(TR.parse_triples(decoded_text(spark, sf))).groupBy("graph_id").agg(F.count(F.lit(1)).alias("triples"))


def _merged(spark, sf):
    return TR.merge_triples(TR.valid_triples(TR.parse_triples(decoded_text(spark, sf))), ["graph_id"], squeezed=True)


@query(
    "merge_triples",
    f"WITH {DECODED} SELECT graph_id, window_idx, pos, head, relation, tail, CAST(1.0 AS DOUBLE) AS score, window_idx AS chunk_id, mentions FROM merged",
)
def merge_triples(spark, sf):
    return _merged(spark, sf)


@query(
    "lateral_triples",
    f"WITH {DECODED} SELECT graph_id, window_idx, pos, head, relation, tail, CAST(1.0 AS DOUBLE) AS score, window_idx AS chunk_id, mentions FROM merged",
)
def lateral_triples(spark, sf):
    """The same triples through the table function, called from SQL."""
    name = table_functions.register(spark)
    rows = spark.sql(
        f"SELECT t.key AS graph_id, t.window_idx, t.window_idx AS chunk_id, t.pos, t.head, t.relation, t.tail, t.score FROM {{texts}} d, LATERAL {name}(d.graph_id, d.window_idx, d.text) t",
        texts=decoded_text(spark, sf),
    )
    return TR.merge_triples(TR.valid_triples(rows), ["graph_id"], squeezed=True)


@query(
    "mention_chunks",
    f"WITH {DECODED} SELECT DISTINCT graph_id, lower(head) AS head, lower(relation) AS relation, lower(tail) AS tail, window_idx AS chunk_id FROM triples",
)
def mention_chunks(spark, sf):
    return TR.mention_chunks(TR.parse_triples(decoded_text(spark, sf)), ["graph_id"], squeezed=True)


@query("entity_ids", f"WITH {DECODED} SELECT graph_id, label, 'entity_' || k AS node_id, k AS ord FROM entities")
def entity_ids(spark, sf):
    return TR.assign_entity_ids(_merged(spark, sf))


@query(
    "triples_to_graph_nodes",
    f"""WITH {DECODED} SELECT graph_id, 'entity_' || k AS node_id, label, 'entity' AS node_type, 'true' AS expandable, 'false' AS expanded,
'rebel' AS origin, label AS original_label FROM entities""",
)
def triples_to_graph_nodes(spark, sf):
    return TR.triples_to_graph(_merged(spark, sf)).nodes.select(
        "graph_id",
        "node_id",
        "label",
        "node_type",
        slots.state("expandable").alias("expandable"),
        slots.state("expanded").alias("expanded"),
        slots.meta("source").alias("origin"),
        slots.meta("original_label").alias("original_label"),
    )


@query(
    "triples_to_graph_edges",
    f"""WITH {DECODED} SELECT m.graph_id, 'entity_' || h.k AS source, 'entity_' || t.k AS target, m.relation, CAST(1.0 AS DOUBLE) AS weight,
row_number() OVER (PARTITION BY m.graph_id ORDER BY m.window_idx, m.pos) - 1 AS ord
FROM merged m JOIN entities h ON h.graph_id = m.graph_id AND h.label = m.head JOIN entities t ON t.graph_id = m.graph_id AND t.label = m.tail""",
)
def triples_to_graph_edges(spark, sf):
    return TR.triples_to_graph(_merged(spark, sf)).edges.select(
        "graph_id", "source", "target", "relation", slots.metric("weight").alias("weight"), "ord"
    )


RECORDS = r"""
said AS (SELECT CAST(conv_id AS VARCHAR) AS graph_id, turn AS window_idx, role, split_part(replace(text, chr(10), ' '), ' ', 1) AS word FROM conversations),
turns AS (
  SELECT graph_id, window_idx, 0 AS pos, role AS head, 'says in ' || window_idx AS relation, word AS tail FROM said
  UNION ALL SELECT graph_id, window_idx, 1, word, 'part of', 'conversation ' || graph_id FROM said),
triples AS (SELECT * FROM turns WHERE head <> '' AND tail <> ''),
seen AS (
  SELECT graph_id, head AS label, window_idx * 4 + pos * 2 AS place FROM triples
  UNION ALL SELECT graph_id, tail, window_idx * 4 + pos * 2 + 1 FROM triples),
entities AS (
  SELECT graph_id, label, row_number() OVER (PARTITION BY graph_id ORDER BY place) AS k FROM (
    SELECT graph_id, label, min(place) AS place FROM seen GROUP BY graph_id, label))"""


@query(
    "relation_records",
    f"WITH {RECORDS} SELECT graph_id, window_idx, CAST(pos AS INTEGER) AS pos, head, relation, tail FROM triples",
)
def relation_records_(spark, sf):
    return TR.relations_to_triples(relation_records(spark, sf)).drop("score")


def _record_graph(spark, sf):
    return TR.triples_to_graph(TR.relations_to_triples(relation_records(spark, sf)), "records")


@query(
    "records_to_graph_nodes",
    f"WITH {RECORDS} SELECT graph_id, 'ent:' || k AS node_id, label, 'false' AS expandable FROM entities",
)
def records_to_graph_nodes(spark, sf):
    return _record_graph(spark, sf).nodes.select("graph_id", "node_id", "label", slots.state("expandable").alias("expandable"))


@query(
    "records_to_graph_edges",
    f"""WITH {RECORDS} SELECT m.graph_id, 'ent:' || h.k AS source, 'ent:' || t.k AS target, m.relation
FROM triples m JOIN entities h ON h.graph_id = m.graph_id AND h.label = m.head JOIN entities t ON t.graph_id = m.graph_id AND t.label = m.tail""",
)
def records_to_graph_edges(spark, sf):
    return _record_graph(spark, sf).edges.select("graph_id", "source", "target", "relation")


@query(
    "extraction_stats",
    f"""WITH {RECORDS}, {SENTENCES}, f AS (SELECT CAST(doc_id AS VARCHAR) AS graph_id, least(count(*), 40) AS facts FROM sent GROUP BY doc_id),
t AS (SELECT graph_id, count(*) AS n FROM triples GROUP BY graph_id)
SELECT graph_id, CAST(facts AS VARCHAR) AS atomic_facts, CAST(coalesce(n, 0) AS VARCHAR) AS triple_count, '31-01-2024' AS obs_timestamp, '1500' AS elapsed_ms
FROM f LEFT JOIN t USING (graph_id)""",
)
def extraction_stats(spark, sf):
    docs = table(spark, sf, "documents")
    facts = docs.select(
        F.col("doc_id").cast("string").alias("graph_id"), T.clamp_facts(T.split_sentences("text")).alias("facts")
    )
    triples = TR.relations_to_triples(relation_records(spark, sf))
    stats = TR.extraction_stats(facts, triples, F.lit("2024-01-31").cast("timestamp"), F.lit(1500))
    names = ["atomic_facts", "triple_count", "obs_timestamp", "elapsed_ms"]
    return stats.select("graph_id", *[slots.meta(n).alias(n) for n in names])


@query(
    "extract_documents",
    rf"""WITH RECURSIVE {SENTENCE_WINDOWS},
words AS (SELECT CAST(doc_id AS VARCHAR) AS graph_id, chunk_id, regexp_split_to_array(trim(text, E' \n'), '\s+') AS w FROM sentence_windows),
triples AS (SELECT graph_id, chunk_id, w[1] AS head, w[len(w) // 2 + 1] AS relation, w[-1] AS tail FROM words),
merged AS (
  SELECT graph_id, f.* FROM (
    SELECT graph_id, arg_min({{'head': head, 'relation': relation, 'tail': tail, 'chunk_id': chunk_id}}, chunk_id) AS f
    FROM triples GROUP BY graph_id, lower(head), lower(relation), lower(tail))),
seen AS (SELECT graph_id, head AS label, chunk_id * 2 AS place FROM merged UNION ALL SELECT graph_id, tail, chunk_id * 2 + 1 FROM merged),
e AS (SELECT graph_id, label, row_number() OVER (PARTITION BY graph_id ORDER BY min(place)) - 1 AS k FROM seen GROUP BY graph_id, label)
SELECT m.graph_id, 'entity_' || h.k AS source, 'entity_' || l.k AS target, m.relation,
       row_number() OVER (PARTITION BY m.graph_id ORDER BY m.chunk_id) - 1 AS ord
FROM merged m JOIN e h ON h.graph_id = m.graph_id AND h.label = m.head JOIN e l ON l.graph_id = m.graph_id AND l.label = m.tail""",
)
def extract_documents(spark, sf):
    """Whole path with a stand-in model: the first words of a window as one triple."""

    def decode(texts):
        words = texts.str.split()
        return words.map(lambda w: f"<triplet> {w[0]} <subj> {w[-1]} <obj> {w[len(w) // 2]}" if w else "")

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("graph_id"), "text")
    g = TR.extract(docs, decode, WindowConfig(window_size=100, overlap=20))
    return g.edges.select("graph_id", "source", "target", "relation", "ord")


@query(
    "extract_record_graphs",
    rf"""WITH {SENTENCES},
f AS (SELECT CAST(doc_id AS VARCHAR) AS graph_id, i, s AS fact FROM sent),
w AS (SELECT graph_id, i, regexp_split_to_array(fact, '\s+') AS w FROM f),
t AS (SELECT graph_id, i, w[1] AS head, w[-1] AS tail FROM w),
seen AS (SELECT graph_id, head AS label, i * 2 AS place FROM t UNION ALL SELECT graph_id, tail, i * 2 + 1 FROM t),
e AS (SELECT graph_id, label, row_number() OVER (PARTITION BY graph_id ORDER BY place) AS k FROM (SELECT graph_id, label, min(place) AS place FROM seen GROUP BY ALL))
SELECT t.graph_id, 'ent:' || h.k AS source, 'ent:' || l.k AS target, 'leads to' AS relation, CAST(i AS BIGINT) AS ord
FROM t JOIN e h ON h.graph_id = t.graph_id AND h.label = t.head JOIN e l ON l.graph_id = t.graph_id AND l.label = t.tail""",
)
def extract_record_graphs(spark, sf):
    """Facts through a stand-in model: first and last word of each fact as a relation record."""

    def relate(batches):
        import json

        def one(facts):
            words = [f.split() for f in facts]
            return json.dumps({"relationships": [{"subject": w[0], "object": {"name": w[-1]}, "type": "leads to"} for w in words]})

        return batches.map(one)

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("graph_id"), "text")
    g = TR.extract_records(docs, relate, F.lit("2024-01-31").cast("timestamp"))
    return g.edges.select("graph_id", "source", "target", "relation", "ord")


@query("embed_labels")
def embed_labels(spark, sf):
    """The default embedding of every part name."""
    from graphloom.functions.vectors import embed

    return embed(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("label")))


@query(
    "embed_label_slots",
    """WITH t AS (SELECT p_partkey, ' ' || lower(p_name) || ' ' AS text FROM part),
g AS (SELECT p_partkey, unnest([substr(text, i, 3) for i in range(1, greatest(length(text) - 2, 1) + 1)]) AS gram FROM t),
c AS (SELECT p_partkey, CAST(('0x' || substr(md5(gram), 1, 7)) AS BIGINT) % 128 AS slot, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY ALL)
SELECT p_partkey, CAST(slot AS INTEGER) AS slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)) AS FLOAT) AS DOUBLE) AS value FROM c""",
)
def embed_label_slots(spark, sf):
    """The n-gram embedding of every part name with a hash that SQL has too, one row per filled slot."""
    from graphloom.functions.vectors import hashed_ngrams

    number = lambda gram: F.conv(F.substring(F.md5(gram), 1, 7), 16, 10).cast("long")
    slots_of = F.posexplode(hashed_ngrams("p_name", number=number)).alias("slot", "value")
    return table(spark, sf, "part").select("p_partkey", slots_of).where("value > 0").withColumn("value", F.col("value").cast("double"))


@query("stable_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def stable_index(spark, sf):
    """File positions; the rows of the table lie in the order of their ids."""
    from graphloom.sources.datasets import with_index

    return with_index(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "idx")


@query(
    "date_stamps",
    "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS stamp, CAST(trunc((o_totalprice - 0.5) * 1000) AS BIGINT) AS ms FROM orders",
)
def date_stamps(spark, sf):
    from graphloom.functions import values

    rows = table(spark, sf, "orders").withColumn("start", F.lit(0.5))
    return rows.select(
        "o_orderkey", values.date_stamp("o_orderdate").alias("stamp"), values.elapsed_ms("start", "o_totalprice").alias("ms")
    )


@query(
    "json_or_text",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '"' || event_type || '"' END AS value FROM events""",
)
def json_or_text(spark, sf):
    from graphloom.functions import values

    mixed = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", values.json_or_text(mixed).alias("value"))
