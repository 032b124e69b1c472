"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import caps, decontaminate, jaccard, language, lm, neighbours, packing, pivots, quality, repeats, spelling, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[..., DataFrame], *tables: str) -> None:
    QUERIES[name] = lambda spark, folder: build(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in tables))


_add("op1_language_id", language.query, "documents")
_add("op2_quality", quality.query, "documents", "labels")
_add("op3_token_counts", tokens.query, "documents")
_add("op4_lm_score", lm.query, "documents")
_add("op5_ngram_jaccard", jaccard.query, "documents")
_add("op6_best_fit_packing", packing.query, "documents")
_add("op7_repeats", repeats.query, "documents")
_add("op8_decontamination", decontaminate.query, "documents", "benchmark")
_add("op9_nearest", neighbours.query, "embeddings")
_add("op10_warc", warc.query, "pages")
_add("op11_spherical_caps", caps.query, "embeddings")
_add("op12_pivot_clusters", pivots.query, "embeddings")
_add("op13_spelling_variants", spelling.query, "documents")

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS t FROM (
  SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT *, least(len(w), 10) AS m FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS t FROM (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT doc_id, s, m, item_id FROM dw JOIN win USING (m, t)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

# sha1 of DuckDB reads text, so the digest is that of the same UTF-8 bytes.
ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS k, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY 1)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN k <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k <> page_id THEN k END AS refers_to
FROM p LEFT JOIN k USING (h)"""
_PLAIN = f"list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLES["op5_ngram_jaccard"] = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g FROM (
  SELECT *, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) USING (doc_id)"""


# All pairs; the query finds those that share a filter.
ORACLES["op11_spherical_caps"] = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS MATERIALIZED (SELECT * FROM v WHERE len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, c AS component_id, c = vec_id AS kept
FROM (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY 1)"""


def _clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """k-means in integers, a few table expressions for each round."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda a: floor(1024 * a)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (
  SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v.x, min(struct_pack(d := {far}, c := c.c)) AS m FROM v, c{i} c GROUP BY ALL)")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM (
    SELECT m.c AS c, p, sum(x[p]) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) t(p) GROUP BY ALL) GROUP BY c) n USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
  (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = m.c"""


ORACLES["op12_pivot_clusters"] = _clusters_sql()

# CRC-32 by its rule, eight steps for each entry of the table; near words by the words that a deleted letter leaves.
ORACLES["op13_spelling_variants"] = """
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(
  [i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
o AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
  FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
b AS (SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x:
  CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes FROM o),
h AS (SELECT w, n, xor(list_reduce([4294967295]::BIGINT[] || bytes::BIGINT[],
  lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0
  THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
x AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (
  SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
y AS (SELECT a.word AS word, b.word AS near FROM x a JOIN x b USING (p, rest) WHERE a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON v.word = rest UNION SELECT v.word, x.word FROM x JOIN v ON v.word = rest),
z AS (SELECT y.word, count(*) AS n_near, min(struct_pack(m := -v.n, near := near)) AS s FROM y JOIN v ON v.word = near GROUP BY 1),
f AS MATERIALIZED (SELECT word, CASE WHEN -s.m >= 5 * n THEN s.near END AS form, n, coalesce(n_near, 0) AS n_near,
  CASE WHEN -s.m >= 5 * n THEN -s.m END AS form_n FROM v LEFT JOIN z USING (word)),
r AS (SELECT word, word AS reached, 0 AS depth FROM f UNION ALL
  SELECT r.word, f.form, depth + 1 FROM r JOIN f ON f.word = r.reached WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(reached, depth) AS root FROM r GROUP BY 1) USING (word)"""
