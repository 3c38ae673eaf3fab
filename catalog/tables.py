"""Inputs that the registered queries derive from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import Graphs, spread


# Tables with much work per row.
KEYS = {"documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, KEYS[name]) if name in KEYS else rows


def epoch_seconds(col: str) -> Column:
    """Whole seconds since 1970 of a time stamp without zone, whatever the session zone is."""
    days = F.date_diff(F.to_date(col), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)


def supply_graph(spark: SparkSession, sf_dir: str) -> Graphs:
    """One graph per nation: its suppliers, the parts they ship, one edge per line item.

    Each part also belongs to the graph ``p_partkey % 25`` (as an isolated node where no
    supplier of that nation ships it).
    """
    supplier = table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").join(
        supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    graph_id = F.col("s_nationkey").cast("string").alias("graph_id")
    edges = lines.select(
        graph_id,
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("edge_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("S"), "l_suppkey").alias("source"),
        F.concat(F.lit("P"), "l_partkey").alias("target"),
        F.col("l_returnflag").alias("relation"),
        F.create_map(F.lit("weight"), F.col("l_quantity")).alias("metrics"),
    )
    sellers = supplier.select(
        graph_id,
        F.concat(F.lit("S"), "s_suppkey").alias("node_id"),
        (F.col("s_suppkey") * 2).alias("ord"),
        F.col("s_name").alias("label"),
        F.lit("supplier").alias("node_type"),
        (F.col("s_acctbal") / 10000).alias("score"),
    )
    placed = (
        lines.select(graph_id, F.col("l_partkey").alias("p_partkey"))
        .unionByName(part.select((F.col("p_partkey") % 25).cast("string").alias("graph_id"), "p_partkey"))
        .distinct()
    )
    parts = placed.join(part, "p_partkey").select(
        "graph_id",
        F.concat(F.lit("P"), "p_partkey").alias("node_id"),
        (F.col("p_partkey") * 2 + 1).alias("ord"),
        F.col("p_name").alias("label"),
        F.lit("part").alias("node_type"),
        ((F.col("p_retailprice") - 900) / 100).alias("score"),
    )
    nodes = sellers.unionByName(parts)
    nodes = nodes.withColumn("attrs", F.create_map(F.lit("score"), F.col("score").cast("string")))
    ids = supplier.select(graph_id).unionByName(part.select((F.col("p_partkey") % 25).cast("string").alias("graph_id")))
    return Graphs.of(nodes, edges, ids.distinct())


SUPPLY = """
edges AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS graph_id,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey AS edge_id,
         l_orderkey * 8 + l_linenumber AS ord,
         'S' || l_suppkey AS source, 'P' || l_partkey AS target,
         l_returnflag AS relation, l_quantity AS weight
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
placed AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS graph_id, l_partkey AS p_partkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION
  SELECT CAST(p_partkey % 25 AS VARCHAR), p_partkey FROM part),
nodes AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS graph_id, 'S' || s_suppkey AS node_id, s_suppkey * 2 AS ord,
         s_name AS label, 'supplier' AS node_type, s_acctbal / 10000 AS score
  FROM supplier
  UNION ALL
  SELECT graph_id, 'P' || p_partkey, p_partkey * 2 + 1, p_name, 'part', (p_retailprice - 900) / 100
  FROM placed JOIN part USING (p_partkey)),
touch AS (
  SELECT graph_id, source AS node_id FROM edges
  UNION ALL
  SELECT graph_id, target FROM edges WHERE target <> source),
degrees AS (
  SELECT n.graph_id, n.node_id, count(t.node_id) AS degree
  FROM nodes n LEFT JOIN touch t USING (graph_id, node_id)
  GROUP BY n.graph_id, n.node_id),
sizes AS (SELECT graph_id, count(*) AS node_count FROM nodes GROUP BY graph_id)
"""


def supply_scored(max_nodes: int) -> str:
    """SQL of the rule-based scoring on the supply graph (depth and iteration 0)."""
    return f"""{SUPPLY},
scored AS (
  SELECT n.graph_id, n.node_id, n.label, n.score, d.degree, s.node_count,
    CASE WHEN s.node_count >= {max_nodes} THEN CASE WHEN d.degree > 2 THEN 'HALT-ACCEPT' ELSE 'HALT-DROP' END
         WHEN s.node_count < 3 OR d.degree = 0 THEN 'HALT-DROP'
         WHEN d.degree > 5 THEN 'HALT-ACCEPT' ELSE 'LOOP' END AS status,
    CASE WHEN s.node_count >= {max_nodes} THEN 'max_nodes'
         WHEN s.node_count < 3 THEN 'insufficient_nodes'
         WHEN d.degree = 0 THEN 'isolated_node'
         WHEN d.degree > 5 THEN 'high_value' ELSE 'continue_expansion' END AS halt_reason
  FROM nodes n JOIN degrees d USING (graph_id, node_id) JOIN sizes s USING (graph_id))
"""


def vector_nodes(spark: SparkSession, sf_dir: str, by_label: bool = False) -> DataFrame:
    """The embeddings as nodes of one graph, or of one graph per label."""
    graph_id = F.col("label").cast("string") if by_label else F.lit("all")
    return table(spark, sf_dir, "embeddings").select(
        graph_id.alias("graph_id"),
        F.concat(F.lit("V"), "vec_id").alias("node_id"),
        F.col("vec_id").alias("ord"),
        "embedding",
    )


def vector_sql(by_label: bool, threshold: float) -> str:
    """``v`` nodes and ``pairs`` with a cosine of at least ``threshold``."""
    graph_id = "CAST(label AS VARCHAR)" if by_label else "'all'"
    return f"""
v AS (SELECT {graph_id} AS graph_id, 'V' || vec_id AS node_id, vec_id AS ord, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT a.graph_id, a.node_id AS id1, b.node_id AS id2, list_cosine_similarity(a.e, b.e) AS sim
  FROM v a JOIN v b ON a.graph_id = b.graph_id AND a.ord < b.ord
  WHERE list_cosine_similarity(a.e, b.e) >= {threshold})"""


COMPONENTS = """
links AS (SELECT graph_id, id1 AS a, id2 AS b FROM pairs UNION SELECT graph_id, id2, id1 FROM pairs),
reach AS (
  SELECT graph_id, node_id, node_id AS other FROM v
  UNION
  SELECT r.graph_id, r.node_id, l.b FROM reach r JOIN links l ON l.graph_id = r.graph_id AND l.a = r.other),
roots AS (SELECT graph_id, node_id, min(other) AS root FROM reach GROUP BY graph_id, node_id)"""


def order_graphs(spark: SparkSession, sf_dir: str) -> tuple[Graphs, Graphs]:
    """Per nation: customers and their orders (evidence), segments and customers (goal).

    The goal side also names orders it does not hold, so some of its edges dangle.
    """
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("c_custkey"), "embedding")
    graph_id = F.col("c_nationkey").cast("string").alias("graph_id")
    people = customer.join(vectors, "c_custkey", "left").select(
        graph_id,
        F.concat(F.lit("C"), "c_custkey").alias("node_id"),
        (F.col("c_custkey") * 2).alias("ord"),
        F.col("c_name").alias("label"),
        F.lit("customer").alias("node_type"),
        "embedding",
    )
    bought = orders.select(
        graph_id,
        F.concat(F.lit("O"), "o_orderkey").alias("node_id"),
        (F.col("o_orderkey") * 2 + 1).alias("ord"),
        F.concat(F.lit("Order "), "o_orderkey").alias("label"),
        F.lit("order").alias("node_type"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    placed = orders.select(
        graph_id,
        F.concat(F.lit("p"), "o_orderkey").alias("edge_id"),
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("C"), "c_custkey").alias("source"),
        F.concat(F.lit("O"), "o_orderkey").alias("target"),
        F.lit("placed").alias("relation"),
    )
    segments = customer.select(
        graph_id,
        F.concat(F.lit("M"), "c_mktsegment").alias("node_id"),
        F.ascii("c_mktsegment").cast("bigint").alias("ord"),
        F.col("c_mktsegment").alias("label"),
        F.lit("segment").alias("node_type"),
        F.lit(None).cast("array<float>").alias("embedding"),
    ).distinct()
    targets = customer.select(
        graph_id,
        F.concat(F.lit("t"), "c_custkey").alias("edge_id"),
        F.col("c_custkey").alias("ord"),
        F.concat(F.lit("M"), "c_mktsegment").alias("source"),
        F.concat(F.lit("C"), "c_custkey").alias("target"),
        F.lit("targets").alias("relation"),
    )
    covers = orders.select(
        graph_id,
        F.concat(F.lit("c"), "o_orderkey").alias("edge_id"),
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("M"), "c_mktsegment").alias("source"),
        F.concat(F.lit("O"), "o_orderkey").alias("target"),
        F.lit("covers").alias("relation"),
    )
    ids = customer.select(graph_id).distinct()
    evidence = ids.withColumns({"source": F.lit("bottom_up"), "depth": F.lit(0)})
    goal = ids.withColumns({"source": F.lit("gpt_expander"), "depth": F.lit(1)})
    return (
        Graphs.of(people.unionByName(bought), placed, evidence),
        Graphs.of(segments.unionByName(people), targets.unionByName(covers), goal),
    )


ORDER = """
o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
people AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS graph_id, 'C' || c_custkey AS node_id, c_custkey * 2 AS ord, c_name AS label,
         'customer' AS node_type, CAST(embedding AS DOUBLE[]) AS e
  FROM customer LEFT JOIN embeddings ON vec_id = c_custkey),
b_nodes AS (
  SELECT * FROM people
  UNION ALL
  SELECT CAST(c_nationkey AS VARCHAR), 'O' || o_orderkey, o_orderkey * 2 + 1, 'Order ' || o_orderkey, 'order', NULL FROM o),
b_edges AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS graph_id, 'C' || c_custkey AS source, 'O' || o_orderkey AS target, 'placed' AS relation FROM o),
t_nodes AS (
  SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS graph_id, 'M' || c_mktsegment AS node_id, ascii(c_mktsegment)::BIGINT AS ord,
         c_mktsegment AS label, 'segment' AS node_type, CAST(NULL AS DOUBLE[]) AS e FROM customer
  UNION ALL SELECT * FROM people),
t_edges AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS graph_id, 'M' || c_mktsegment AS source, 'C' || c_custkey AS target, 'targets' AS relation FROM customer
  UNION ALL
  SELECT CAST(c_nationkey AS VARCHAR), 'M' || c_mktsegment, 'O' || o_orderkey, 'covers' FROM o),
f_nodes AS (
  SELECT graph_id, 'fused_B_' || node_id AS node_id, label, node_type, 'bottom_up' AS origin, ord, e FROM b_nodes
  UNION ALL
  SELECT graph_id, 'fused_T_' || node_id, label, node_type, 'top_down', ord + 35184372088832, e FROM t_nodes),
f_edges AS (
  SELECT graph_id, 'fused_B_' || source AS source, 'fused_B_' || target AS target, relation, 'bottom_up' AS origin FROM b_edges
  WHERE (graph_id, source) IN (SELECT graph_id, node_id FROM b_nodes) AND (graph_id, target) IN (SELECT graph_id, node_id FROM b_nodes)
  UNION ALL
  SELECT graph_id, 'fused_T_' || source, 'fused_T_' || target, relation, 'top_down' FROM t_edges
  WHERE (graph_id, source) IN (SELECT graph_id, node_id FROM t_nodes) AND (graph_id, target) IN (SELECT graph_id, node_id FROM t_nodes))"""

FUSED = f"""{ORDER},
v AS (SELECT graph_id, node_id, ord, e FROM f_nodes WHERE e IS NOT NULL),
pairs AS (
  SELECT a.graph_id, a.node_id AS id1, b.node_id AS id2
  FROM v a JOIN v b ON a.graph_id = b.graph_id AND a.ord < b.ord
  WHERE list_cosine_similarity(a.e, b.e) >= 0.3),
{COMPONENTS},
moved AS (SELECT graph_id, node_id, root FROM roots WHERE root <> node_id)"""


def order_increment(spark: SparkSession, sf_dir: str, statuses: list[str]) -> tuple[Graphs, list[Graphs]]:
    """Customers with their finished orders, and one increment per further order status.

    An increment holds new orders, known customers and edges to the next order key, some of
    which exist nowhere; it grows from the first customer of the nation.
    """
    evidence, _ = order_graphs(spark, sf_dir)
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    graph_id = F.col("c_nationkey").cast("string").alias("graph_id")
    done = orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("O"), "o_orderkey").alias("node_id"))
    nodes = evidence.nodes
    kept = nodes.where("node_type = 'customer'").unionByName(nodes.join(done, "node_id", "left_semi").select(*nodes.columns))
    edges = evidence.edges.join(done.withColumnRenamed("node_id", "target"), "target", "left_semi")
    current = Graphs(evidence.graphs, kept, edges.select(*evidence.edges.columns))
    first = customer.groupBy(graph_id).agg(F.concat(F.lit("C"), F.min("c_custkey")).alias("parent"))
    header = first.select(
        "graph_id", F.create_map(F.lit("parent_node_id"), F.col("parent")).alias("meta"), F.lit("gpt_expander").alias("source")
    )
    steps = []
    for status in statuses:
        part = orders.where(F.col("o_orderstatus") == status)
        new = part.select(
            graph_id,
            F.concat(F.lit("O"), "o_orderkey").alias("node_id"),
            (F.col("o_orderkey") * 2 + 1).alias("ord"),
            F.concat(F.lit("Order "), "o_orderkey").alias("label"),
        )
        known = part.select(
            graph_id,
            F.concat(F.lit("C"), "c_custkey").alias("node_id"),
            (F.col("c_custkey") * 2).alias("ord"),
            F.lit("known").alias("label"),
        ).distinct()
        placed = part.select(
            graph_id,
            F.concat(F.lit("p"), "o_orderkey").alias("edge_id"),
            F.col("o_orderkey").alias("ord"),
            F.concat(F.lit("C"), "c_custkey").alias("source"),
            F.concat(F.lit("O"), "o_orderkey").alias("target"),
            F.lit("placed").alias("relation"),
        )
        follows = part.select(
            graph_id,
            F.concat(F.lit("n"), "o_orderkey").alias("edge_id"),
            F.col("o_orderkey").alias("ord"),
            F.concat(F.lit("O"), "o_orderkey").alias("source"),
            F.concat(F.lit("O"), F.col("o_orderkey") + 1).alias("target"),
            F.lit("next").alias("relation"),
        )
        steps.append(Graphs.of(new.unionByName(known), placed.unionByName(follows), header))
    return current, steps


def increment_sql(rounds: list[str]) -> str:
    """``cur0`` … ``curN`` node tables and ``edge0`` … ``edgeN`` after each merged increment."""
    parts = [
        """
o AS (SELECT CAST(c_nationkey AS VARCHAR) AS graph_id, * FROM orders JOIN customer ON o_custkey = c_custkey),
cur0 AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS graph_id, 'C' || c_custkey AS node_id, c_name AS label FROM customer
  UNION ALL SELECT graph_id, 'O' || o_orderkey, 'Order ' || o_orderkey FROM o WHERE o_orderstatus = 'F'),
edge0 AS (SELECT graph_id, 'C' || c_custkey AS source, 'O' || o_orderkey AS target, 'placed' AS relation FROM o WHERE o_orderstatus = 'F')"""
    ]
    for k, status in enumerate(rounds, start=1):
        parts.append(f"""
inc{k} AS (
  SELECT graph_id, 'O' || o_orderkey AS node_id, 'Order ' || o_orderkey AS label FROM o WHERE o_orderstatus = '{status}'
  UNION SELECT graph_id, 'C' || c_custkey, 'known' FROM o WHERE o_orderstatus = '{status}'),
raw{k} AS (
  SELECT graph_id, 'C' || c_custkey AS source, 'O' || o_orderkey AS target, 'placed' AS relation FROM o WHERE o_orderstatus = '{status}'
  UNION ALL
  SELECT graph_id, 'O' || o_orderkey, 'O' || (o_orderkey + 1), 'next' FROM o WHERE o_orderstatus = '{status}'),
add{k} AS (SELECT * FROM inc{k} WHERE (graph_id, node_id) NOT IN (SELECT graph_id, node_id FROM cur{k - 1})),
cur{k} AS (SELECT * FROM cur{k - 1} UNION ALL SELECT * FROM add{k}),
valid{k} AS (
  SELECT * FROM raw{k} WHERE (graph_id, source) IN (SELECT graph_id, node_id FROM cur{k})
    AND (graph_id, target) IN (SELECT graph_id, node_id FROM cur{k})),
edge{k} AS (SELECT * FROM edge{k - 1} UNION ALL SELECT * FROM valid{k})""")
    parts.append("""
parent AS (SELECT CAST(c_nationkey AS VARCHAR) AS graph_id, 'C' || min(c_custkey) AS node_id FROM customer GROUP BY c_nationkey)""")
    return ",".join(parts)


def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linearised triples made of the first words of each sentence, one text per sentence.

    Repeats in another case and spacing are part of it.
    """
    from graphloom.functions.text import split_sentences

    sentences = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("graph_id"), F.posexplode(split_sentences("text")).alias("window_idx", "s")
    )
    words = F.split(F.replace("s", F.lit("\n"), F.lit(" ")), " +", 6)  # five are read
    w = [F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in range(5)]
    text = F.concat(
        F.lit("<s><triplet> "), w[0], F.lit("  "), w[1], F.lit(" <subj>  "), w[2], F.lit(" <obj> "), w[3],
        F.lit(" <subj> "), F.lower(w[0]), F.lit("<obj>"), w[4],
        F.lit("<triplet> "), F.lower(w[0]), F.lit(" "), w[1], F.lit(" <subj> "), F.lower(w[2]), F.lit(" <obj> "), w[3], F.lit("</s>"),
    )
    return sentences.select("graph_id", "window_idx", F.col("window_idx").alias("chunk_id"), text.alias("text"))


SENTENCES = r"""
sent AS (
  SELECT doc_id, text, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS s FROM (
    SELECT doc_id, text, list_filter(list_transform(
      string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: trim(x, E' \n')), lambda x: x <> '') AS parts FROM documents))"""

DECODED = rf"""{SENTENCES},
words AS (SELECT CAST(doc_id AS VARCHAR) AS graph_id, CAST(i AS INTEGER) AS window_idx, regexp_split_to_array(translate(s, chr(10), ' '), ' +') AS w FROM sent),
decoded AS (
  SELECT graph_id, window_idx, '<triplet> ' || coalesce(w[1], '') || '  ' || coalesce(w[2], '') || ' <subj>  ' || coalesce(w[3], '') || ' <obj> '
    || coalesce(w[4], '') || ' <subj> ' || lower(coalesce(w[1], '')) || '<obj>' || coalesce(w[5], '')
    || '<triplet> ' || lower(coalesce(w[1], '')) || ' ' || coalesce(w[2], '') || ' <subj> ' || lower(coalesce(w[3], '')) || ' <obj> ' || coalesce(w[4], '') AS d FROM words),
contents AS (
  SELECT graph_id, window_idx, generate_subscripts(c, 1) AS ci, unnest(c) AS content FROM (
    SELECT graph_id, window_idx, string_split(d, '<triplet>')[2:] AS c FROM decoded)),
pieces AS (
  SELECT graph_id, window_idx, ci, trim(regexp_replace(string_split(content, '<subj>')[1], '\s+', ' ', 'g')) AS head,
         generate_subscripts(string_split(content, '<subj>')[2:], 1) AS pi, unnest(string_split(content, '<subj>')[2:]) AS p FROM contents),
parsed AS (
  SELECT graph_id, window_idx, ci, pi, head, trim(regexp_replace(split_part(p, '<obj>', 2), '\s+', ' ', 'g')) AS relation,
         trim(regexp_replace(split_part(p, '<obj>', 1), '\s+', ' ', 'g')) AS tail FROM pieces),
triples AS (
  SELECT graph_id, window_idx, CAST(row_number() OVER (PARTITION BY graph_id, window_idx ORDER BY ci, pi) - 1 AS INTEGER) AS pos, head, relation, tail
  FROM parsed WHERE head <> '' AND relation <> '' AND tail <> ''),
merged AS (
  SELECT graph_id, first.head AS head, first.relation AS relation, first.tail AS tail, first.window_idx AS window_idx, first.pos AS pos, mentions FROM (
    SELECT graph_id, arg_min({{'head': head, 'relation': relation, 'tail': tail, 'window_idx': window_idx, 'pos': pos}}, (window_idx, pos)) AS first, count(*) AS mentions
    FROM triples GROUP BY graph_id, lower(head), lower(relation), lower(tail))),
labels_seen AS (
  SELECT graph_id, head AS label, window_idx, pos, 0 AS side FROM merged UNION ALL SELECT graph_id, tail, window_idx, pos, 1 FROM merged),
entities AS (
  SELECT graph_id, label, row_number() OVER (PARTITION BY graph_id ORDER BY w, p, s) - 1 AS k FROM (
    SELECT graph_id, label, f.window_idx AS w, f.pos AS p, f.side AS s FROM (
      SELECT graph_id, label, min({{'window_idx': window_idx, 'pos': pos, 'side': side}}) AS f FROM labels_seen GROUP BY graph_id, label)))"""


def relation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per turn of a conversation: two relation records under varying names."""
    turns = table(spark, sf_dir, "conversations")
    word = F.substring_index(F.translate("text", "\n", " "), " ", 1)
    says = F.struct(
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("head"),
        F.when(F.col("turn") % 2 == 1, F.struct(F.lit("").alias("name"), F.col("role").alias("label"))).alias("startEntity"),
        F.concat(F.lit(" says  in "), F.col("turn")).alias("predicate"),
        F.struct(word.alias("name")).alias("object"),
    )
    part = F.struct(
        F.lit(None).cast("string").alias("head"),
        F.struct(F.lit("").alias("name"), word.alias("label")).alias("startEntity"),
        F.lit("part of").alias("predicate"),
        F.struct(F.concat(F.lit("conversation "), "conv_id").alias("name")).alias("object"),
    )
    records = F.array(says, part)
    even = F.col("conv_id") % 2 == 0
    document = F.struct(F.when(even, records).alias("relations"), F.when(~even, records).alias("edges"))
    return turns.select(
        F.col("conv_id").cast("string").alias("graph_id"), F.col("turn").alias("window_idx"), F.to_json(document).alias("json")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator answers made of conversation turns: plain JSON, JSON in prose, cut-off JSON."""
    turns = table(spark, sf_dir, "conversations")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    w = [F.coalesce(F.get(words, F.lit(i)), F.lit("w")) for i in range(3)]
    key = F.concat_ws("-", "conv_id", "turn")
    body = F.concat(
        F.lit('{"parent_node_id":"P'), "conv_id", F.lit('","reason":"'), w[0],
        F.lit('","nodes":[{"id":"a'), "turn", F.lit('","label":"'), w[0], F.lit('","type":"concept","description":"'), w[1],
        F.lit('"},{"name":"'), w[2], F.lit('"},{"id":"c"}],"edges":[{"source":"P'), "conv_id", F.lit('","target":"a'), "turn",
        F.lit('","relation":"contains"},{"source":"a'), "turn",
        F.lit('","target":"node_1"},{"source":"x","target":"y","relation":"none"}]}'),
    )
    kind = F.col("turn") % 3
    text = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Sure, here it is:\n"), body, F.lit("\nDone.")))
        .otherwise(F.substring(body, 1, 60))
    )
    return turns.select(key.alias("graph_id"), text.alias("response"))


RESPONSES = r"""
w AS (SELECT conv_id, turn, conv_id || '-' || turn AS graph_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations),
body AS (
  SELECT graph_id, turn, '{"parent_node_id":"P' || conv_id || '","reason":"' || coalesce(w[1], 'w') || '","nodes":[{"id":"a' || turn || '","label":"'
    || coalesce(w[1], 'w') || '","type":"concept","description":"' || coalesce(w[2], 'w') || '"},{"name":"' || coalesce(w[3], 'w')
    || '"},{"id":"c"}],"edges":[{"source":"P' || conv_id || '","target":"a' || turn || '","relation":"contains"},{"source":"a' || turn
    || '","target":"node_1"},{"source":"x","target":"y","relation":"none"}]}' AS b FROM w),
responses AS (
  SELECT graph_id, CASE turn % 3 WHEN 0 THEN b WHEN 1 THEN 'Sure, here it is:' || chr(10) || b || chr(10) || 'Done.' ELSE left(b, 60) END AS response FROM body),
salvaged AS (
  SELECT graph_id, CASE WHEN json_valid(response) THEN response WHEN json_valid(regexp_extract(response, '(?s)\{.*\}')) THEN regexp_extract(response, '(?s)\{.*\}') END AS j
  FROM responses),
r_nodes AS (
  SELECT graph_id, i - 1 AS ord, coalesce(n->>'id', 'node_' || (i - 1)) AS node_id, coalesce(n->>'label', n->>'name', '节点_' || (i - 1)) AS label,
         coalesce(n->>'type', 'system') AS node_type, coalesce(n->>'description', '') AS description
  FROM (SELECT graph_id, unnest(json_extract(j, '$.nodes[*]')) AS n, generate_subscripts(json_extract(j, '$.nodes[*]'), 1) AS i FROM salvaged WHERE j IS NOT NULL)),
r_edges AS (
  SELECT graph_id, e->>'source' AS source, e->>'target' AS target, coalesce(e->>'relation', 'related_to') AS relation
  FROM (SELECT graph_id, unnest(json_extract(j, '$.edges[*]')) AS e FROM salvaged WHERE j IS NOT NULL))"""


def fever_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as claims with label and page pointers; web pages as evidence pages."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    pages = table(spark, sf_dir, "pages")
    rows = docs.join(pages, F.col("doc_id") == F.col("page_id"), "left").select(
        F.col("doc_id").alias("idx"),
        F.col("text").alias("claim"),
        F.when(F.col("quality") == 1, "SUPPORTS").when(F.col("quality") == 0, "REFUTES").alias("label"),
        F.concat(F.lit(" "), "url").alias("evidence_wiki_url"),
        (F.col("doc_id") % 12 - 1).cast("int").alias("evidence_sentence_id"),
        F.col("doc_id").cast("int").alias("evidence_id"),
    )
    return rows, pages.select(F.col("url").alias("title"), F.col("html").alias("text"))


FEVER = r"""
pages_ AS (
  SELECT trim(url) AS title, max(trim(regexp_replace(html, '\n{3,}', E'\n\n', 'g'), E' \n\t\r')) AS page FROM pages GROUP BY ALL),
fever AS (
  SELECT d.doc_id AS idx, d.text AS claim, CASE quality WHEN 1 THEN 'SUPPORTS' WHEN 0 THEN 'REFUTES' END AS label, ' ' || url AS wiki,
         CAST(d.doc_id % 12 - 1 AS INTEGER) AS sid
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id),
looked AS (
  SELECT f.*, page, list_filter(list_transform(string_split(regexp_replace(page, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS s FROM fever f LEFT JOIN pages_ ON title = trim(wiki)),
fever_samples AS (
  SELECT 'fever' AS dataset_id, 'train' AS split, idx AS "index", claim AS query, label, wiki, sid,
    CASE WHEN page IS NOT NULL THEN CASE WHEN sid >= 0 AND sid < len(s) THEN s[sid + 1] ELSE page END END AS sentence, page
  FROM looked),
fever_out AS (
  SELECT dataset_id, split, "index", query, label, coalesce(nullif(sentence, ''), nullif(page, ''), query) AS context,
    CASE WHEN sentence IS NULL THEN to_json({'evidence_wiki_url': wiki, 'evidence_sentence_id': sid, 'evidence_id': "index", 'evidence_annotation_id': NULL})
    ELSE to_json({'evidence_wiki_url': wiki, 'evidence_sentence_id': sid, 'evidence_id': "index", 'evidence_annotation_id': NULL, 'evidence_text': sentence}) END::VARCHAR AS evidence
  FROM fever_samples)"""


def docred_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tokenised relation samples; title, abstract and labels are missing in some."""
    from graphloom.functions.text import split_sentences

    words = F.transform(split_sentences("text"), lambda s: F.split(s, " "))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"),
        F.when(F.col("lang") == "en", F.concat(F.lit("T"), "doc_id")).alias("title"),
        F.when(F.col("lang") == "fr", F.col("text")).alias("abstract"),
        words.alias("sents"),
        F.transform(words, lambda w: F.array(F.struct(F.get(w, F.lit(0)).alias("name")))).alias("vertexSet"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.col("source").alias("r"), F.lit(0).alias("h"), F.lit(0).alias("t"))))
        .otherwise(F.array().cast("array<struct<r:string,h:int,t:int>>"))
        .alias("labels"),
    )


DOCRED = rf"""
parts AS (
  SELECT doc_id, text, lang, source, list_filter(list_transform(
      string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: trim(x, E' \n')), lambda x: x <> '') AS p FROM documents),
docred AS (
  SELECT doc_id AS idx, lang, text, source, p, list_transform(p, lambda s: string_split(s, ' ')) AS sents,
    list_transform(p, lambda s: [{{'name': string_split(s, ' ')[1]}}]) AS "vertexSet",
    CASE WHEN doc_id % 2 = 0 THEN [{{'r': source, 'h': 0, 't': 0}}] ELSE [] END AS labels,
    CASE WHEN lang = 'en' THEN 'T' || doc_id WHEN lang = 'fr' THEN left(text, 200)
         WHEN doc_id % 2 = 0 THEN '提取文本中的' || source || '关系' ELSE '从文本中提取实体和关系' END AS query FROM parts)"""


def scifact_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as claims that cite documents; the corpus has ids that are no numbers and old copies."""
    from graphloom.functions.text import split_sentences

    claims = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("idx"),
        F.col("text").alias("claim"),
        F.col("role").alias("evidence_label"),
        F.when(F.col("turn") % 2 == 0, F.col("conv_id")).cast("int").alias("evidence_doc_id"),
        F.when(F.col("turn") % 4 == 1, F.array(F.col("turn"), F.col("turn") + 50).cast("array<int>"))
        .when(F.col("turn") % 4 == 2, F.array().cast("array<int>"))
        .alias("evidence_sentences"),
        F.when(F.col("turn") % 3 == 0, F.array().cast("array<int>"))
        .otherwise(F.array(F.col("conv_id") + 1, F.lit(1)).cast("array<int>"))
        .alias("cited_doc_ids"),
    )
    docs = table(spark, sf_dir, "documents")
    fresh = docs.select(
        F.when(F.col("lang") == "de", F.concat(F.lit("x"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("doc_id"),
        F.when(F.col("lang") != "fr", F.col("source")).alias("title"),
        split_sentences("text").alias("abstract"),
        F.col("doc_id").alias("idx"),
    )
    old = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("old").alias("title"), F.array("lang").alias("abstract"), F.lit(-1).alias("idx")
    )
    return claims, fresh.unionByName(old)


SCIFACT = r"""
corpus_ AS (
  SELECT doc_id, CASE WHEN lang = 'de' THEN 'old' WHEN lang = 'fr' THEN NULL ELSE source END AS title,
    CASE WHEN lang = 'de' THEN [lang] ELSE list_filter(list_transform(
      string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: trim(x, E' \n')), lambda x: x <> '') END AS lines FROM documents),
claims AS (
  SELECT conv_id * 100 + turn AS idx, text AS claim, role AS label, turn,
    CASE WHEN turn % 2 = 0 AND conv_id > 0 THEN conv_id WHEN turn % 3 <> 0 THEN conv_id + 1 END AS picked,
    CASE WHEN turn % 4 = 1 THEN [turn, turn + 50] WHEN turn % 4 = 2 THEN [] END AS ev
  FROM conversations),
scifact AS (
  SELECT c.*, title, lines, CASE WHEN doc_id IS NULL THEN NULL WHEN title IS NULL THEN array_to_string(lines, chr(10))
    ELSE trim(title || E'\n\n' || array_to_string(lines, chr(10)), E' \n') END AS doc
  FROM claims c LEFT JOIN corpus_ ON doc_id = picked AND picked > 0)"""


def runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Experiments from the event stream: one per user, its events as trace, its orders as nodes."""
    events = table(spark, sf_dir, "events").withColumn("experiment_id", F.col("user_id").cast("string"))
    user = F.col("user_id")
    strategies = F.array(*[F.lit(s) for s in ("asi", "psg", "scd", "ucb", "rule_based")])
    experiments = events.groupBy("experiment_id", "user_id").agg(F.min("ts").alias("created_at")).select(
        "experiment_id",
        F.concat(F.lit("Run "), user).alias("name"),
        F.concat(F.lit("goal "), user % 3).alias("goal"),
        F.get(strategies, (user % 5).cast("int")).alias("halting_strategy"),
        F.when(user % 7 == 0, "running").when(user % 7 == 1, "completed").otherwise("success").alias("status"),
        "created_at",
    )
    nodes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("experiment_id"), F.concat(F.lit("O"), "o_orderkey").alias("node_id")
    )
    nodes = nodes.join(experiments.select("experiment_id"), "experiment_id", "left_semi")
    seconds = epoch_seconds("ts").cast("double").alias("ts")
    trace = events.select(
        "experiment_id",
        F.col("event_id").alias("seq"),
        seconds,
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("action"),
        F.to_json(F.struct("value")).alias("details"),
    )
    logs = events.where("event_type = 'error'").select(
        "experiment_id",
        F.col("event_id").alias("seq"),
        seconds,
        F.lit("ERROR").alias("level"),
        F.concat(F.lit("event "), "event_id").alias("message"),
    )
    k = F.get_json_object("props", "$.k").cast("bigint")
    stats = events.groupBy("experiment_id", F.col("event_type").alias("stage")).agg(
        F.sum(k).alias("node_count"), F.count(F.lit(1)).alias("edge_count")
    )
    stats = stats.select("*", F.lit(0).alias("depth"), F.lit("events").alias("source"))
    counted = events.groupBy("experiment_id").agg(F.count(F.lit(1)).cast("string").alias("n"))
    metrics = counted.select(
        "experiment_id", F.explode(F.create_map(F.lit("events"), F.col("n"), F.lit("note"), F.lit('plain "text"'))).alias("key", "value")
    )
    return {"experiments": experiments, "nodes": nodes, "trace": trace, "logs": logs, "stats": stats, "metrics": metrics}


def run_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buckets of :func:`runs`."""
    from graphloom.operators import analysis

    r = runs(spark, sf_dir)
    graphs = r["experiments"].select(
        "experiment_id",
        F.explode(F.array(F.lit("G_B"), F.lit("G_T"))).alias("stage"),
        F.lit(0).alias("part"),
        F.lit("").alias("json"),
    )
    text = F.when(F.col("stage") == "G_B", F.lit('{"nodes":[]}')).otherwise(F.lit("{cut off"))
    return (
        analysis.trace_bucket(r["trace"])
        .unionByName(analysis.log_bucket(r["logs"]))
        .unionByName(analysis.stats_bucket(r["stats"]))
        .unionByName(analysis.metric_bucket(r["metrics"]))
        .unionByName(analysis.graph_bucket(graphs.withColumn("json", text)))
    )


RUNS = r"""
ev AS (SELECT CAST(user_id AS VARCHAR) AS experiment_id, * FROM events),
experiments AS (
  SELECT experiment_id, 'Run ' || user_id AS name, 'goal ' || (user_id % 3) AS goal,
    ['asi', 'psg', 'scd', 'ucb', 'rule_based'][user_id % 5 + 1] AS halting_strategy,
    CASE user_id % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'success' END AS status, min(ts) AS created_at
  FROM ev GROUP BY experiment_id, user_id),
nodes AS (
  SELECT CAST(o_custkey AS VARCHAR) AS experiment_id, 'O' || o_orderkey AS node_id FROM orders
  WHERE CAST(o_custkey AS VARCHAR) IN (SELECT experiment_id FROM experiments)),
trace AS (
  SELECT experiment_id, event_id AS seq, event_id // 1000 AS part, CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE event_type END AS action FROM ev),
node_totals AS (SELECT experiment_id, count(*) AS node_count FROM nodes GROUP BY experiment_id),
trace_totals AS (SELECT experiment_id, count(*) AS iterations FROM trace GROUP BY experiment_id),
stats AS (
  SELECT experiment_id, event_type AS stage, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS node_count,
    count(*) AS edge_count, 0 AS depth, 'events' AS source FROM ev GROUP BY experiment_id, event_type)"""


def telemetry(events: DataFrame) -> DataFrame:
    """Event rows as telemetry envelopes in JSON; large purchases lack a payload."""
    seconds = epoch_seconds("ts")
    stats = F.concat(
        F.lit('{"intermediate_stats":{"'), "event_type", F.lit('":{"node_count":'), F.get_json_object("props", "$.k"),
        F.lit(',"edge_count":'), F.col("event_id"), F.lit(',"depth":0,"source":"events"}}}'),
    )
    log = F.concat(F.lit('{"message":"event '), F.col("event_id"), F.lit('","level":"ERROR","timestamp":'), seconds, F.lit("}"))
    is_log = F.col("event_type") == "error"
    lost = (F.col("event_type") == "purchase") & (F.col("value") > 50)
    payload = F.when(is_log, log).otherwise(stats)
    head = F.concat(
        F.lit('{"experimentId":"'), "user_id", F.lit('","type":"'), F.when(is_log, "LOG").otherwise("TELEMETRY"),
        F.lit('","timestamp":'), seconds, F.lit(',"seq":'), F.col("event_id"),
    )
    tail = F.when(lost, F.lit("}")).otherwise(F.concat(F.lit(',"payload":'), payload, F.lit("}")))
    return events.select("event_id", F.concat(head, tail).alias("value"))


TELEMETRY = r"""
sent AS (
  SELECT CAST(user_id AS VARCHAR) AS experiment_id, CASE WHEN event_type = 'error' THEN 'LOG' ELSE 'TELEMETRY' END AS type,
    floor(epoch(ts))::DOUBLE AS ts, event_id AS seq, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) AS node_count
  FROM events WHERE NOT (event_type = 'purchase' AND value > 50))"""
