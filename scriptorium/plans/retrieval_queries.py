"""Queries of storage and retrieval: documents are chunks, benchmark texts and vectors whose id is divisible by 20 are queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieve as R
from ..operators.scope import Scopes, bitmaps, permitted_scopes
from ..sources import index as I
from .corpus_queries import PAGES, pages
from .registry import Tables, query
from .text_queries import tokens_sql

# ------------------------------------------------------------------ storage


@query(
    """
SELECT doc_id, CASE WHEN b > 100000000 THEN 'too large' WHEN p = 0 THEN 'no pages' WHEN p > 300 THEN 'too many pages' END AS error, CASE WHEN b > 100000000 OR p = 0 OR p > 300 THEN 'failed' ELSE 'ready' END AS status
FROM (SELECT doc_id, n_chars * 5000 AS b, n_chars // 40 AS p FROM documents)
"""
)
def ingest_validate(t: Tables) -> DataFrame:
    raw = t.documents.select("doc_id", (F.col("n_chars") * 5000).alias("bytes"), F.floor(F.col("n_chars") / 40).alias("page_count"))
    return I.validate(raw).select("doc_id", "error", "status")


def _uploads(t: Tables) -> DataFrame:
    status = F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("ready")
    return t.documents.select("doc_id", F.col("lang").alias("owner_id"), F.encode("text", "UTF-8").alias("content"), status.alias("status"))


@query(
    """
WITH h AS (SELECT doc_id, lang AS owner_id, sha256(text) AS sha256, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents),
l AS (SELECT owner_id, sha256, min(doc_id) AS first_id FROM h WHERE status = 'ready' GROUP BY ALL)
SELECT h.doc_id, h.sha256, first_id, CASE WHEN first_id IS NULL THEN 'retry' WHEN h.doc_id = first_id THEN 'new' WHEN status = 'ready' THEN 'duplicate' ELSE 'retry' END AS decision FROM h LEFT JOIN l USING (owner_id, sha256)
"""
)
def dedup_by_owner(t: Tables) -> DataFrame:
    return I.dedup(_uploads(t)).select("doc_id", "sha256", "first_id", "decision")


def _chunks(t: Tables) -> DataFrame:
    """A summary chunk of each fourth document and one body chunk of each."""
    body = t.documents.select("doc_id", F.lit(0).alias("ordinal"), F.lit("body").alias("kind"), F.col("source").alias("section"), "text")
    return body.unionByName(t.documents.where("doc_id % 4 = 0").select("doc_id", F.lit(0).alias("ordinal"), F.lit("summary").alias("kind"), F.lit("").alias("section"), "text"))


@query(
    """
SELECT doc_id, CASE kind WHEN 'summary' THEN 0 ELSE 1 END AS ordinal, kind FROM (SELECT doc_id, 'body' AS kind, text FROM documents UNION ALL SELECT doc_id, 'summary', text FROM documents WHERE doc_id % 4 = 0)
WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
"""
)
def index_append(t: Tables) -> DataFrame:
    live = t.labels.select("doc_id", (F.col("quality") != 1).alias("deleted"))
    return I.append_index(_chunks(t), live).select("doc_id", "ordinal", "kind")


@query(
    """
SELECT 'd' AS kind, doc_id AS id, CASE WHEN toxic = 1 THEN 'deleted' ELSE 'ready' END AS state, CASE WHEN toxic = 1 THEN NULL ELSE source END AS rest FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'p', page_id, 'kept', NULL FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'c', doc_id, CASE WHEN toxic = 1 THEN 'deleted' ELSE 'live' END, CASE WHEN toxic = 1 THEN '' ELSE text END FROM documents LEFT JOIN labels USING (doc_id)
"""
)
def soft_delete(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.lit("ready").alias("status"), F.col("source").alias("summary"))
    pages = t.pages.select(F.col("page_id").alias("doc_id"))
    chunks = t.documents.select("doc_id", "text", F.lit(False).alias("deleted"))
    d, p, c = I.soft_delete(docs, pages, chunks, t.labels.where("toxic = 1"))
    return (
        d.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.col("status").alias("state"), F.col("summary").alias("rest"))
        .unionByName(p.select(F.lit("p").alias("kind"), F.col("doc_id").alias("id"), F.lit("kept").alias("state"), F.lit(None).cast("string").alias("rest")))
        .unionByName(c.select(F.lit("c").alias("kind"), F.col("doc_id").alias("id"), F.when(F.col("deleted"), "deleted").otherwise("live").alias("state"), F.col("text").alias("rest")))
    )


@query(
    """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN c.text ELSE coalesce(d.text, c.text) END AS text FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id AND c.turn = 0
"""
)
def page_refresh(t: Tables) -> DataFrame:
    """Turns stand for pages; those of the assistant for pages read from images."""
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(F.col("role") == "assistant", "ocr").otherwise("text").alias("source"), "text")
    fresh = t.documents.select("doc_id", F.lit(0).cast("long").alias("page_no"), "text")
    return I.refresh_pages(pages, fresh).select(F.col("doc_id").alias("conv_id"), F.col("page_no").alias("turn"), "text")


@query(
    """
SELECT user_id AS doc_id, 10000 + k AS ordinal, 'Şekil — s. ' || k AS section, '[Şekil açıklaması] ' || event_type AS text FROM (
  SELECT user_id, event_id % 40 AS k, event_type, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC, event_type DESC) AS r FROM events) WHERE r = 1
"""
)
def figure_chunks(t: Tables) -> DataFrame:
    figures = t.events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 40).alias("page_no"), F.col("event_type").alias("text"), F.col("ts").alias("created_at"))
    return I.figure_chunks(figures).select("doc_id", "ordinal", "section", "text")


@query("SELECT doc_id, label, n_chars FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 7 <> 0")
def snapshot_join(t: Tables) -> DataFrame:
    chunks = t.documents.select("doc_id", "n_chars", (F.col("doc_id") % 7 == 0).alias("deleted"))
    return I.snapshot(chunks, t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")).select("doc_id", "label", "n_chars")


TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLES))
def table_counts(t: Tables) -> DataFrame:
    return I.table_counts({n: getattr(t, n) for n in TABLES})


EMPTIED = ["conversations", "events", "labels"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, {'0::BIGINT' if n in EMPTIED else 'count(*)'} AS n FROM {n if n not in EMPTIED else '(SELECT 1)'}" for n in TABLES))
def reset_memory(t: Tables) -> DataFrame:
    """What is left when conversations, traces and votes are forgotten and documents are kept."""
    return I.table_counts(I.reset({n: getattr(t, n) for n in TABLES}, EMPTIED))


@query("SELECT doc_id, quality, NULL::VARCHAR AS lang FROM labels UNION ALL SELECT doc_id, NULL, lang FROM documents")
def schema_merge(t: Tables) -> DataFrame:
    return I.merge_schema(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", "lang"))


# ------------------------------------------------------------------ statistics and ranked lists

TERMS = f"terms AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS token FROM (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents))"
LENGTHS = f"lengths AS (SELECT count(*) AS n, avg(len({tokens_sql('text')})) AS avg_length FROM documents)"


@query(f"WITH {TERMS} SELECT token, count(DISTINCT doc_id) AS df FROM terms GROUP BY 1")
def token_df(t: Tables) -> DataFrame:
    return R.token_df(t.documents)


@query(f"WITH {LENGTHS} SELECT n AS chunks, avg_length FROM lengths")
def corpus_stats(t: Tables) -> DataFrame:
    return R.corpus_stats(t.documents)


@query(f"WITH {TERMS} SELECT doc_id, token, length, count(*) AS tf FROM terms GROUP BY ALL")
def term_freq(t: Tables) -> DataFrame:
    return R.postings(t.documents)


def bm25_sql(k: int, scope: str | None = None) -> str:
    """CTE bm25(query_id, doc_id, score, rank); scope: SQL of (query_id, doc_id)."""
    n = f"JOIN (SELECT query_id, count(*) AS n FROM ({scope}) GROUP BY 1) s USING (query_id)" if scope else ""
    inside = f"JOIN ({scope}) USING (query_id, doc_id)" if scope else ""
    return f"""
{TERMS}, {LENGTHS}, tf AS (SELECT doc_id, token, length, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tokens_sql('text')})) AS token FROM benchmark),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + ({'s.n' if scope else 'l.n'} - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score
  FROM q JOIN df USING (token) JOIN tf USING (token) {inside} {n} CROSS JOIN lengths l GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})
"""


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {bm25_sql(5)} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM bm25")
def bm25_topk(t: Tables) -> DataFrame:
    return R.bm25(questions(t), t.documents, 5)


SCOPE = "SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON CAST(substr(source, 4) AS INTEGER) % 5 = item_id % 5"


def _scope(t: Tables) -> Scopes:
    """Fifths of the sources: five sets, of which each query takes one."""
    fifth = lambda c: (c % 5).cast("string").alias("scope_id")
    return Scopes(t.benchmark.select(F.col("item_id").alias("query_id"), fifth(F.col("item_id"))), bitmaps(t.documents.select(fifth(F.substr("source", F.lit(4)).cast("int")), "doc_id")))


@query(f"WITH {bm25_sql(8, SCOPE)} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM bm25")
def scoped_search(t: Tables) -> DataFrame:
    return R.bm25(questions(t), t.documents, 8, scope=_scope(t))


DOT = "round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"


def dense_sql(k: int, name: str = "dense") -> str:
    """CTE dense(query_id, vec_id, score, rank) of the vectors whose id is divisible by 20."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, {DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0)) WHERE rank <= {k})"""


def _probes(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {dense_sql(20)} SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM dense")
def dense_topk(t: Tables) -> DataFrame:
    return R.cosine(_probes(t), t.embeddings, 20)


# A query's vector is the vector of its number; a document's is that of its id, where there is one.
def both_sql(width: int) -> str:
    """CTEs of both ranked lists of `width` candidates and f(query_id, doc_id, fused, rank_dense, rank_sparse)."""
    return f"""
{bm25_sql(width)}, dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT item_id AS query_id, e.vec_id AS doc_id, {DOT} AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings e JOIN documents d ON d.doc_id = e.vec_id)) WHERE rank <= {width}),
u AS (SELECT query_id, doc_id, rank AS rd, NULL AS rs FROM dense UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm25),
f AS (SELECT query_id, doc_id, round(coalesce(1 / (60 + min(rd))::DOUBLE, 0) + coalesce(1 / (60 + min(rs))::DOUBLE, 0), 9) AS fused, min(rd) AS rank_dense, min(rs) AS rank_sparse FROM u GROUP BY ALL)
"""


COSINE = f"(SELECT {DOT} FROM embeddings q, embeddings e WHERE q.vec_id = h.query_id AND e.vec_id = h.doc_id)"
FUSED_ORDER = "fused DESC, rank_dense NULLS LAST, rank_sparse NULLS LAST, doc_id"


def _hybrid(t: Tables, top_k: int, mode: str = "hybrid", cap: int = 0) -> DataFrame:
    """Documents are chunks; their sources stand for documents."""
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = questions(t).join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    chunks = t.documents.select("doc_id", "source", "text").join(vectors, "doc_id", "left")
    return R.hybrid_search(asked, chunks, top_k, mode, cap, key="doc_id", doc="source")


@query(f"WITH {both_sql(32)}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {FUSED_ORDER}) AS rank FROM f) WHERE rank <= 8) SELECT query_id, doc_id, fused, {COSINE} AS dense_score, rank::INTEGER AS rank FROM h")
def hybrid_search(t: Tables) -> DataFrame:
    return _hybrid(t, 8).select("query_id", "doc_id", "fused", "dense_score", "rank")


@query(
    f"""
WITH {both_sql(32)}, c AS (SELECT f.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY {FUSED_ORDER}) AS own FROM f JOIN documents USING (doc_id))
SELECT query_id, doc_id, source, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {FUSED_ORDER}) AS rank FROM c WHERE own <= 1) WHERE rank <= 8
"""
)
def capped_topk(t: Tables) -> DataFrame:
    """At most one hit of each source."""
    return _hybrid(t, 8, cap=1).select("query_id", "doc_id", "source", "rank")


@query(
    f"""
WITH {both_sql(20)}, m AS (SELECT 'hybrid' AS mode, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {FUSED_ORDER}) AS rank FROM f UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dense UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM bm25)
SELECT mode, query_id, doc_id FROM m WHERE rank <= 4
"""
)
def hybrid_modes(t: Tables) -> DataFrame:
    out = None
    for mode in ("hybrid", "dense", "bm25"):
        one = _hybrid(t, 4, mode).select(F.lit(mode).alias("mode"), "query_id", "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


VARIANTS = f"""
{dense_sql(10, 'd1')}, d2 AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d1),
l AS (SELECT d1.*, 0 AS variant FROM d1 UNION ALL SELECT *, 1 FROM d2 WHERE query_id % 100 = 0),
n AS (SELECT query_id, count(DISTINCT variant) AS variants FROM l GROUP BY 1),
m AS (SELECT query_id, l.vec_id, label, variants, round(sum(1 / (60 + rank)::DOUBLE), 9) AS fused, max(score) AS dense_score, min(rank) AS best FROM l JOIN n USING (query_id) JOIN embeddings e ON e.vec_id = l.vec_id GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY fused DESC, best, vec_id) AS own FROM m WHERE variants > 1)
"""


@query(
    f"""
WITH {VARIANTS} SELECT query_id, vec_id, fused, dense_score, rank::INTEGER AS rank FROM (
  SELECT query_id, vec_id, fused, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM m WHERE variants = 1
  UNION ALL SELECT query_id, vec_id, fused, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, best, vec_id) FROM o WHERE own <= 3) WHERE rank <= 8
"""
)
def fuse_variants(t: Tables) -> DataFrame:
    first = R.cosine(_probes(t), t.embeddings, 10)
    back = Window.partitionBy("query_id").orderBy("score", "vec_id")
    second = first.where("query_id % 100 = 0").withColumn("rank", F.row_number().over(back))
    lists = first.withColumn("variant", F.lit(0)).unionByName(second.withColumn("variant", F.lit(1))).withColumnRenamed("score", "dense_score")
    return R.fuse(lists.join(t.embeddings.select("vec_id", "label"), "vec_id"), 8, 3, "vec_id", "label").select("query_id", "vec_id", "fused", "dense_score", "rank")


@query("SELECT vec_id % 20 AS query_id, greatest(3, ceil(24.0::DOUBLE / count(DISTINCT label)))::BIGINT AS cap FROM embeddings GROUP BY 1")
def scope_cap(t: Tables) -> DataFrame:
    return R.scope_cap(t.embeddings.select((F.col("vec_id") % 20).alias("query_id"), F.col("label").alias("doc_id")))


PRF = f"""
{dense_sql(3)}, x AS (SELECT d.query_id, generate_subscripts(e.embedding, 1) AS i, unnest(e.embedding)::DOUBLE AS x FROM dense d JOIN embeddings e USING (vec_id)),
m AS (SELECT query_id, i, avg(x) AS m FROM x GROUP BY ALL), b AS (SELECT query_id, i, 0.7::DOUBLE * embedding[i]::DOUBLE + 0.3::DOUBLE * m AS v FROM m JOIN embeddings ON vec_id = query_id),
z AS (SELECT query_id, sqrt(sum(v * v)) AS z FROM b GROUP BY 1), moved AS (SELECT query_id, list(v / z ORDER BY i) AS v FROM b JOIN z USING (query_id) GROUP BY 1)
"""


@query(f"WITH {PRF} SELECT query_id, i - 1 AS d, round(v / z, 6) AS x FROM b JOIN z USING (query_id)")
def prf_vector(t: Tables) -> DataFrame:
    probes = _probes(t)
    moved = R.feedback_vectors(R.cosine(probes, t.embeddings, 3), t.embeddings, probes)
    return moved.select("query_id", F.posexplode("embedding").alias("d", "x")).select("query_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


def _prf(t: Tables) -> tuple[DataFrame, DataFrame]:
    probes = _probes(t)
    first = R.cosine(probes, t.embeddings, 8)
    return first, R.cosine(R.feedback_vectors(first, t.embeddings, probes), t.embeddings, 8)


PRF_SECOND = f"second AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, e.vec_id, round(list_dot_product(v, e.embedding::DOUBLE[]), 6) AS score FROM moved CROSS JOIN embeddings e)) WHERE rank <= 8), {dense_sql(8, 'first8')}"


@query(f"WITH {PRF}, {PRF_SECOND} SELECT query_id, vec_id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS fused FROM (SELECT query_id, vec_id, rank FROM first8 UNION ALL SELECT query_id, vec_id, rank FROM second) GROUP BY ALL")
def prf_search(t: Tables) -> DataFrame:
    first, second = _prf(t)
    both = first.unionByName(second)
    return both.groupBy("query_id", "vec_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("fused"))


@query(f"WITH {PRF}, {PRF_SECOND} SELECT query_id, count(*) AS gained FROM (SELECT query_id, vec_id FROM second EXCEPT SELECT query_id, vec_id FROM first8) GROUP BY 1")
def prf_gain(t: Tables) -> DataFrame:
    first, second = _prf(t)
    return second.join(first, ["query_id", "vec_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("gained"))


@query(
    f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0),
b AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, label) AS r FROM (SELECT query_id, label, max(score) AS m FROM s GROUP BY ALL))
SELECT query_id, label, vec_id, rank::INTEGER AS rank FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s JOIN b USING (query_id, label) WHERE r <= 8) WHERE rank <= 3
"""
)
def per_doc_search(t: Tables) -> DataFrame:
    """Labels stand for documents: the three best vectors in each of the eight labels that fit a query best."""
    return R.per_document(_probes(t), t.embeddings.select("vec_id", "label", "embedding"), "vec_id", "label").select("query_id", "label", "vec_id", "rank")


BANDS = f"{dense_sql(20)}, banded AS (SELECT query_id, (rank - 1)::INTEGER AS idx, vec_id, score, CASE WHEN score < 0.35 THEN 'drop' WHEN score >= 0.6 THEN 'sure' ELSE 'grade' END AS band FROM dense)"


def _banded(t: Tables) -> DataFrame:
    hits = R.cosine(_probes(t), t.embeddings, 20)
    return R.grade_bands(hits.select("query_id", (F.col("rank") - 1).alias("idx"), "vec_id", F.col("score").alias("dense_score")))


@query(f"WITH {BANDS} SELECT query_id, band, count(*) AS n FROM banded GROUP BY ALL")
def grade_bands(t: Tables) -> DataFrame:
    return _banded(t).groupBy("query_id", "band").agg(F.count(F.lit(1)).alias("n"))


GRADED = f"""
{BANDS}, g AS (SELECT query_id, idx, quality = 1 AS relevant, CASE WHEN toxic = 0 THEN 0.5 + idx / 100.0::DOUBLE ELSE 0.5 END AS grade FROM banded JOIN labels ON doc_id = vec_id WHERE query_id % 100 = 0),
kept AS (SELECT b.*, grade FROM banded b LEFT JOIN g USING (query_id, idx) WHERE band <> 'drop' AND (band = 'sure' OR query_id NOT IN (SELECT query_id FROM g) OR relevant)),
applied AS (SELECT query_id, idx, band, row_number() OVER (PARTITION BY query_id ORDER BY band = 'sure' DESC, CASE WHEN band = 'sure' THEN score ELSE grade END DESC NULLS LAST, idx) AS position FROM kept)
"""


def _applied(t: Tables) -> DataFrame:
    banded = _banded(t)
    grade = F.when(F.col("toxic") == 0, 0.5 + F.col("idx") / 100)
    grades = banded.where("query_id % 100 = 0").join(t.labels.withColumnRenamed("doc_id", "vec_id"), "vec_id").select("query_id", "idx", (F.col("quality") == 1).alias("relevant"), grade.alias("score"))
    return R.apply_grades(banded, grades)


@query(f"WITH {GRADED} SELECT query_id, idx, band, position::INTEGER AS position FROM applied")
def apply_grades(t: Tables) -> DataFrame:
    return _applied(t)


@query(f"WITH {GRADED} SELECT query_id, count(*) >= 2 AS sufficient FROM applied GROUP BY 1")
def sufficient(t: Tables) -> DataFrame:
    return _applied(t).groupBy("query_id").agg((F.count(F.lit(1)) >= 2).alias("sufficient"))


@query(
    f"""
WITH {both_sql(32)}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {FUSED_ORDER}) AS r FROM f)
SELECT query_id, coalesce(max({COSINE}), -1) >= 0.5 AS rescued FROM h WHERE r <= 8 GROUP BY 1
"""
)
def scope_rescue(t: Tables) -> DataFrame:
    return R.rescue(_hybrid(t, 8))


@query(
    f"""
WITH fb AS (SELECT vec_id AS id, CASE WHEN toxic = 1 THEN -1 ELSE 1 END AS vote, CASE WHEN vec_id % 3 > 0 THEN 'p' || label END AS predicted, CASE WHEN toxic = 1 AND vec_id % 2 = 0 THEN 'c' || label END AS corrected, embedding FROM embeddings JOIN labels ON doc_id = vec_id),
told AS (SELECT * FROM fb WHERE (vote = -1 AND corrected IS NOT NULL) OR (vote = 1 AND predicted IS NOT NULL) ORDER BY id DESC LIMIT 200),
s AS (SELECT q.vec_id AS query_id, id, coalesce(corrected, predicted) AS category, round(list_dot_product(q.embedding::DOUBLE[], told.embedding::DOUBLE[]), 6) AS score FROM embeddings q CROSS JOIN told WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 5
"""
)
def fewshot(t: Tables) -> DataFrame:
    bad = F.col("toxic") == 1
    votes = t.embeddings.join(t.labels, F.col("doc_id") == F.col("vec_id")).select(
        F.col("vec_id").alias("id"), F.when(bad, -1).otherwise(1).alias("vote"), F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("p"), "label")).alias("predicted"),
        F.when(bad & (F.col("vec_id") % 2 == 0), F.concat(F.lit("c"), "label")).alias("corrected"), "embedding",
    )
    return R.fewshot(_probes(t), votes, least=0.2)


# ------------------------------------------------------------------ scope, neighbours, budgets

LIVE = "live AS (SELECT doc_id, source AS owner_id, lang = 'es' AS shared FROM documents WHERE doc_id % 13 <> 0)"
NAMED = "named AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON doc_id % (SELECT count(*) FROM benchmark) = item_id WHERE item_id % 2 = 0)"


def _acl(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("source").alias("owner_id"), F.when(F.col("lang") == "es", "ortak").otherwise("ozel").alias("visibility"), F.when(F.col("doc_id") % 13 == 0, "deleted").otherwise("ready").alias("status"))


def of_items(t: Tables, *columns: str) -> DataFrame:
    """(query_id, doc_id, …): documents dealt over the benchmark's items by the rest of their id."""
    return t.documents.select((F.col("doc_id") % t.benchmark.count()).alias("query_id"), "doc_id", *columns)


@query(f"WITH {LIVE} SELECT doc_id, owner_id, shared FROM live")
def visible_docs(t: Tables) -> DataFrame:
    return R.permitted(_acl(t))


@query(
    f"""
WITH {LIVE}, u AS (SELECT DISTINCT source AS user_id FROM documents), v AS (SELECT user_id, doc_id, CASE WHEN owner_id = user_id THEN 'own' ELSE 'shared' END AS kind FROM u JOIN live ON owner_id = user_id OR shared)
SELECT user_id, doc_id, kind, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY doc_id DESC) AS rank FROM v) WHERE rank <= 60
"""
)
def document_list(t: Tables) -> DataFrame:
    return R.document_list(_acl(t), t.documents.select(F.col("source").alias("user_id")).distinct())


@query(
    f"""
WITH {LIVE}, {NAMED}, q AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS user_id FROM benchmark)
SELECT query_id, doc_id FROM q JOIN live ON shared OR owner_id = user_id WHERE query_id NOT IN (SELECT query_id FROM named) UNION ALL SELECT query_id, doc_id FROM q JOIN named USING (query_id) JOIN live USING (doc_id) WHERE shared OR owner_id = user_id
"""
)
def scope_filter(t: Tables) -> DataFrame:
    return R.scoped(*_permission(t))


def _permission(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("user_id"))
    named = of_items(t).join(t.benchmark.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id")), "query_id").select("query_id", "doc_id")
    return asked, named, R.permitted(_acl(t))


@query(
    f"""
WITH {LIVE}, {NAMED}, q AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS user_id FROM benchmark), p AS (
SELECT query_id, doc_id FROM q JOIN live ON shared OR owner_id = user_id WHERE query_id NOT IN (SELECT query_id FROM named) UNION ALL SELECT query_id, doc_id FROM q JOIN named USING (query_id) JOIN live USING (doc_id) WHERE shared OR owner_id = user_id)
SELECT query_id, count(*) AS n, sum(doc_id)::BIGINT AS key_sum FROM p GROUP BY 1
"""
)
def scope_sets(t: Tables) -> DataFrame:
    """How many documents each query's scope holds and the sum of their numbers, from sets that queries share."""
    return permitted_scopes(*_permission(t)).sizes().select("query_id", "n", F.col("key_sum").cast("long").alias("key_sum"))


@query(f"WITH {LIVE}, {NAMED}, q AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS user_id FROM benchmark), h AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON doc_id % 3 = item_id % 3) SELECT query_id, count(*) AS n, sum(doc_id)::BIGINT AS key_sum FROM h JOIN q USING (query_id) JOIN live USING (doc_id) WHERE (shared OR owner_id = user_id) AND (query_id NOT IN (SELECT query_id FROM named) OR (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM named)) GROUP BY 1")
def scope_test(t: Tables) -> DataFrame:
    """Of each query's third of the documents, those in its scope."""
    thirds = t.documents.select("doc_id", (F.col("doc_id") % 3).alias("third"))
    hits = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("third")).join(thirds, "third").select("query_id", "doc_id")
    return permitted_scopes(*_permission(t)).keep(hits).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("key_sum"))


@query(
    """
WITH r AS (SELECT user_id AS query_id, event_id AS pos, try_cast(json_extract_string(props, '$.k') AS BIGINT) * 7 AS doc_id FROM events WHERE event_type <> 'error')
SELECT query_id, doc_id, count(*) AS named FROM r WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0) GROUP BY ALL
"""
)
def valid_refs(t: Tables) -> DataFrame:
    k = (F.get_json_object("props", "$.k").cast("long") * 7).cast("string")
    raw = F.when(F.col("event_type") == "error", F.array(F.lit("none"), F.lit("x1"))).otherwise(F.array(k, F.lit("-"), k))
    refs = t.events.select(F.col("event_id").alias("query_id"), "user_id", raw.alias("raw"))
    docs = t.documents.select("doc_id", F.when(F.col("doc_id") % 13 == 0, "deleted").otherwise("ready").alias("status"))
    return R.valid_refs(refs, docs).join(refs.select("query_id", "user_id"), "query_id").groupBy(F.col("user_id").alias("query_id"), "doc_id").agg(F.count(F.lit(1)).alias("named"))


@query("SELECT d.doc_id, d.source || ' ' || coalesce(l.quality::VARCHAR, d.lang) AS title, length(text) AS chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def chunk_docs(t: Tables) -> DataFrame:
    met = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return met.select("doc_id", F.concat_ws(" ", "source", F.coalesce(F.col("quality").cast("string"), "lang")).alias("title"), F.length("text").alias("chars"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def doc_chunks(t: Tables) -> DataFrame:
    return t.conversations.join(t.labels.where("quality = 1").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi").select("conv_id", "turn", "role")


@query(
    """
WITH h AS (SELECT conv_id % 10 AS query_id, conv_id AS doc_id, turn AS ordinal FROM conversations WHERE turn % 3 = 1)
SELECT DISTINCT h.query_id, c.conv_id AS doc_id, c.turn AS ordinal FROM h JOIN conversations c ON c.conv_id = h.doc_id AND c.turn BETWEEN h.ordinal - 1 AND h.ordinal + 1 WHERE (h.query_id, c.conv_id, c.turn) NOT IN (SELECT (query_id, doc_id, ordinal) FROM h)
"""
)
def neighbours(t: Tables) -> DataFrame:
    chunks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"))
    return R.neighbours(chunks.where("ordinal % 3 = 1").withColumn("query_id", F.col("doc_id") % 10), chunks)


@query(
    """
SELECT query_id, rank, before FROM (SELECT conv_id AS query_id, turn + 1 AS rank, coalesce(sum(length(text) * 10) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations) WHERE rank <= 2 OR before < 12000
"""
)
def char_budget(t: Tables) -> DataFrame:
    hits = t.conversations.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), (F.length("text") * 10).alias("chars"))
    return R.char_budget(hits, floor=2).select("query_id", "rank", "before")


@query(
    """
WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, turn, r, CASE WHEN n <= 900 THEN n ELSE 0 END AS used, n <= 900 AS kept FROM c WHERE r = 1 UNION ALL
  SELECT c.conv_id, c.turn, c.r, CASE WHEN used + n <= 900 THEN used + n ELSE used END, used + n <= 900 FROM f JOIN c ON c.conv_id = f.conv_id AND c.r = f.r + 1)
SELECT conv_id AS query_id, turn AS pos FROM f WHERE kept
"""
)
def neighbour_fill(t: Tables) -> DataFrame:
    return R.first_fit(t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.length("text").alias("chars")), 900)


@query(
    """
SELECT conv_id AS query_id, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN sum(length(text)) <= 24000 AND count(DISTINCT turn) <= 8 THEN 'read' ELSE 'search' END WHEN sum(length(text)) <= 1600 THEN 'read' ELSE 'search' END AS route FROM conversations GROUP BY 1
"""
)
def full_read_route(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), F.length("text").alias("chars"), (F.col("conv_id") % 2 == 0).alias("cross_document"))
    return R.full_read_route(rows, single=1600).select("query_id", "route")


@query(
    """
WITH a AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt, o_orderkey % 4 AS hits FROM orders),
s AS (SELECT query_id, max(hits) AS most, max(attempt) AS last FROM a GROUP BY 1)
SELECT query_id, CASE WHEN most > max(hits) FILTER (attempt = last) THEN min(attempt) FILTER (hits = most) ELSE last END::INTEGER AS attempt FROM a JOIN s USING (query_id) GROUP BY query_id, most, last
"""
)
def best_attempt(t: Tables) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return R.best_attempt(t.orders.select(F.col("o_custkey").alias("query_id"), number.alias("attempt"), (F.col("o_orderkey") % 4).alias("hits")))


@query(
    """
SELECT item_id AS query_id, 0 AS v, text FROM benchmark WHERE trim(text) <> '' UNION ALL SELECT item_id, 1, CASE WHEN item_id % 2 = 0 THEN text || ' ?' ELSE lower(translate(text, 'İI', 'iı')) END FROM benchmark WHERE item_id % 2 = 0
"""
)
def query_variants(t: Tables) -> DataFrame:
    full = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" ?"))).otherwise(X.tr_lower(F.col("text")))
    return R.query_variants(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("search"), full.alias("full")))


@query(
    rf"""
WITH {PAGES}, o AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '([\p{{L}}\p{{N}}_/-]+)', 1)) AS term, generate_subscripts(regexp_extract_all(text, '([\p{{L}}\p{{N}}_/-]+)', 1), 1) AS pos FROM benchmark),
w AS (SELECT query_id, arg_min(term, pos) AS term FROM o GROUP BY query_id, lower(term)),
s AS (SELECT *, list_distinct({tokens_sql('term')}) AS ts FROM w WHERE length(term) >= 2 AND regexp_matches(term, '^\p{{Lu}}|\p{{Nd}}') AND NOT regexp_matches(term, '^\p{{Nd}}+$')),
p AS (SELECT query_id, term, len(ts) AS need, unnest(ts) AS token FROM s), h AS (SELECT doc_id, page_no, unnest(list_distinct({tokens_sql('text')})) AS token FROM pages),
g AS (SELECT query_id, term, doc_id, page_no FROM p JOIN h USING (token) GROUP BY query_id, term, need, doc_id, page_no HAVING count(*) = need),
d AS (SELECT query_id, term, doc_id, string_agg(page_no::VARCHAR, ',' ORDER BY page_no) AS pages FROM g GROUP BY ALL),
c AS (SELECT DISTINCT query_id, term FROM d WHERE doc_id % (SELECT count(*) FROM benchmark) = query_id)
SELECT query_id, term, doc_id, pages FROM d WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM c)
"""
)
def term_hints(t: Tables) -> DataFrame:
    hints = R.term_hints(questions(t), of_items(t), pages(t))
    return hints.select("query_id", "term", "doc_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))
