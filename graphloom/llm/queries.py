"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import alignment, decontaminate, filters, jaccard, language, neighbours, pieces, pivots, pseudo, quality, recompression, suffixes, warc
from graphloom.llm.registry import QUERIES, SQL, query  # noqa: F401
from graphloom.llm.tables import documents, table
from graphloom.session import checkpoint_dir

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op6_benchmark_decontamination",
    f"""
WITH dw AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, {_LETTERS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
    FROM iw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(s) WHERE len(w) > 0
),
lens AS (SELECT DISTINCT n FROM win),
dpos AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM dw, lens, unnest(generate_series(1, len(w) - n + 1)) AS u(s)),
hit AS (SELECT DISTINCT doc_id, s, n, item FROM dpos JOIN win USING (n, t)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '')"""


@query(
    "op9_warc",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.decode(pieces.encode(documents(table(spark, sf_dir, "documents")))))


_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_REPEATS = f"""
WITH w AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
p AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM w, unnest(generate_series(1, len(w) - 49)) AS u(s)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS m FROM p) WHERE doc_id > m),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(generate_series(s, s + 49)) AS k FROM r) GROUP BY 1),
k AS (
    SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
           CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ks, i)) END AS kept
    FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query("op3_recompression_substring_dedup", _REPEATS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digest(documents(table(spark, sf_dir, "documents")))


_LOWER_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


@query(
    "op5_ngram_jaccard_join",
    f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, c FROM r JOIN l ON x = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c)::BIGINT AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(documents(table(spark, sf_dir, "documents")))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"), "lang")
    return language.identify(docs, language.train(docs))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"), "lang")
    return quality.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "perplexity", "threshold", "accepted")


@query("op8_pseudo_likelihood")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    return pseudo.score(docs, pseudo.train(docs))


@query("op4_sparse_suffix_dedup", _REPEATS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(documents(table(spark, sf_dir, "documents")))


@query(
    "op12_filter_interactions",
    r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
    SELECT doc_id, part,
           (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
           + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS m
    FROM w
),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
    SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[:step])::INT - bits[step] AS before FROM o, unnest(generate_series(1, 5)) AS u(step)),
r AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), digest=True)


@query("op11_pivot_permutation_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))
