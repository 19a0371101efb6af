"""Registered queries of this subpackage, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, conversations, decontaminate, html_text, language, lines, minhash, mixing, simhash, tokens, topk, toxicity, urls
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), (F.col("quality") == 1).alias("label"))
    return urls.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk.quantized(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text"))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int = 5) -> str:
    """CTEs a0, c1, a1, … of assignments (rid, m: 64 * distance + centroid) and centroids; v and c0 are given."""
    out = []
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT v.rid, min(64 * (v.sq + c.sq - 2 * list_dot_product(v.q, c.q))::BIGINT + c.c) AS m FROM v CROSS JOIN c{r} c GROUP BY 1)")
        if r < rounds:
            out.append(
                f"m{r} AS (SELECT c, list(x ORDER BY i) AS q FROM (SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT m % 64 AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r} JOIN v USING (rid)) GROUP BY ALL) GROUP BY 1),\n"
                f"c{r + 1} AS MATERIALIZED (SELECT c, q, list_dot_product(q, q) AS sq FROM (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN m{r} n ON o.c = n.c))"
            )
    return ",\n".join(out)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def _edits_sql() -> str:
    """op13 as a recursion over turns: a state is {c: cost, a: audit, r: repaired lines}; the least struct is the cheapest, then the least audit."""
    add = lambda x, letter, cost, line: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'r': {f'coalesce({x}.r || chr(10), {chr(39) * 2}) || {line}' if line else f'{x}.r'}}} END"
    user, assistant = (lambda x: add(x, "I", 3, "'user:'")), (lambda x: add(x, "I", 3, "'assistant:'"))
    first = f"SELECT *, list_min([s2, {user('s0')}, {user('s1')}, {user('s3')}]) AS u1, list_min([s3, {assistant('s2')}]) AS v1"
    second = f"SELECT *, list_min([u1, {user('v1')}]) AS u, list_min([v1, {assistant('u1')}]) AS v"
    may = lambda x: f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {x} END"
    kept = "role || ':' || text"
    keep = lambda x, initial: may(f"CASE WHEN ini = '{initial}' THEN {add(x, 'K', 'more', kept)} END")
    rerole = lambda x, name: may(add(x, "R", "(3 + more)", f"'{name}:' || text"))
    delete = lambda x: add(x, "D", 4, "")
    to_user = ", ".join(f"{keep(x, 'u')}, {rerole(x, 'user')}" for x in ("s0", "s1", "v"))
    kind = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), e AS (
  SELECT *, xor(list_reduce(flatten(list_transform(string_split(k, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, t: CASE WHEN t >= 0 THEN xor(c, t) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS f FROM d
), g AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM e JOIN (VALUES (0), (1)) x(n) ON f <> 0 AND (n = 0 OR f = 3)
), h AS (
  SELECT *, substr(role, 1, 1) AS ini, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g
), w AS MATERIALIZED (
  SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS two FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM h)
), o AS (
  SELECT i.conv_id, count(w.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id GROUP BY 1
), r AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': NULL::VARCHAR}} AS s0, {kind} AS s1, {kind} AS s2, {kind} AS s3 FROM o
  UNION ALL
  SELECT conv_id, i, {delete('s0')}, list_min([{delete('s1')}, {keep('s0', 's')}]), list_min([{delete('u')}, {to_user}]), list_min([{delete('v')}, {keep('u', 'a')}, {rerole('u', 'assistant')}]) FROM (
    {second} FROM ({first} FROM (SELECT r.* EXCLUDE (i), w.i, w.role, w.text, w.ini, w.fault, w.more FROM r JOIN w ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i + 1)))
), z AS (SELECT conv_id, i, list_min([s0, v]) AS best FROM ({second} FROM ({first} FROM r)))
SELECT o.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM o JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id AND z.i = o.n
"""


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_decontamination, op3_mixing, op4_url_filter, op5_line_dedup, op6_topk, op7_tokens, op8_toxicity, op9_language, op10_html, op11_hyperminhash, op12_centroids, op13_conversations)}

ORACLES = {
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS lost FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op6_topk": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 20
""",
    "op12_centroids": f"""
WITH u AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT *, list_dot_product(q, q) AS sq FROM u),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1) AS c, q, sq FROM v ORDER BY 1 LIMIT 40),
{_rounds_sql()},
f AS (SELECT vec_id, m % 64 AS c, m // 64 AS distance FROM a5 JOIN v USING (rid))
SELECT vec_id, f.c::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY f.c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c5.q::BIGINT[], ',')) AS centroid_sha256 FROM f JOIN c5 ON c5.c = f.c
""",
    "op13_conversations": _edits_sql(),
}
