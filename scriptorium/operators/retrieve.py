"""Retrieval for a table of queries over a table of chunks: ranked lists, fusion, budgets, grading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import text as X
from .scope import Scopes
from .vectors import nearest, nearest_within


#: Terms that a task counts at a time; a row with more is counted alone.
TERMS = 1 << 17


def _some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (key, terms) as slices of about TERMS terms."""
    ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TERMS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _count(empty: bool):
    """Rows (key, terms) to (key, length, token, tf); empty: a row without token for those that have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _some(whole)):
            lists = batch.column(1)
            lengths, words = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()
            size = max(1, len(words.dictionary))
            found, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + words.indices.to_numpy(), return_counts=True)
            row, token = found // size, words.dictionary.take(pa.array(found % size))
            if empty and (bare := np.flatnonzero(lengths == 0)).size:
                row, tf, token = np.r_[row, bare], np.r_[tf, np.zeros(len(bare), tf.dtype)], pa.concat_arrays([token, pa.nulls(len(bare), token.type)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(lengths[row]), token, pa.array(tf, pa.int64())], names=["key", "length", "token", "tf"])

    return run


def postings(chunks: DataFrame, key: str = "doc_id", empty: bool = False) -> DataFrame:
    """(key, length, token, tf) of chunks (key, text): counted where the text is read, nothing moves. empty: chunks without terms have a row without token."""
    cut = chunks.select(key, X.tokenize(F.col("text")).alias("ts"))
    return cut.mapInArrow(_count(empty), f"key {dict(cut.dtypes)[key]}, length long, token string, tf long").withColumnRenamed("key", key)


def token_df(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.select(F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.avg(F.size(X.tokenize(F.col("text")))).alias("avg_length"))


def top(scored: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("query_id",), rank: str = "rank") -> DataFrame:
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def bm25(queries: DataFrame, chunks: DataFrame, k: int, scope: DataFrame | Scopes | None = None, idf_scope: str = "scope", key: str = "doc_id") -> DataFrame:
    """(query_id, key, score, rank): the k best chunks of each query (query_id, text).

    scope: (query_id, key), or Scopes of keys, the chunks a query may see, applied before anything is ranked. As
    with the default idf_scope, the idf counts the chunks in scope against document frequencies
    of the whole corpus, so it can be negative; scores of zero or less don't rank. Postings are
    cut to the query's tokens before they are counted; a second pass gives the corpus sums.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("token"))
    found = postings(chunks, key)
    sizes = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(X.tokenize(F.col("text")))).alias("avg_length"))
    hits = found.join(asked.select("token").distinct(), "token", "left_semi")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    met = asked.join(df, "token").join(hits, "token").crossJoin(F.broadcast(sizes))  # sizes is one row
    if scope is not None:
        sets = isinstance(scope, Scopes)
        met = scope.keep(met, key) if sets else met.join(scope, ["query_id", key], "left_semi")
        if idf_scope == "scope":
            sizes = scope.sizes().select("query_id", "n") if sets else scope.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
            met = met.drop("n").join(sizes, "query_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k1, b = LIMITS.k1, LIMITS.b
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    scored = met.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return top(scored, k, F.desc("score"), F.col(key))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(queries: DataFrame, chunks: DataFrame, k: int, scope: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank) by the product of unit vectors (queries: query_id, embedding).

    Each task multiplies its chunks with a block of queries at once and keeps its own k best of
    a query before anything moves. With a scope, only its pairs (query_id, key) meet.
    """
    if scope is None:
        found = nearest(queries, chunks, k, key)
    else:
        pairs = scope.select("query_id", key).distinct().join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
        found = pairs.join(chunks.select(key, F.col("embedding").alias("e")), key).select("query_id", key, F.round(dot("q", "e"), 6).alias("score")).where("score IS NOT NULL")
    return top(found, k, F.desc("score"), F.col(key))


def rrf(dense: DataFrame, sparse: DataFrame, key: str, k: int = LIMITS.rrf_k) -> DataFrame:
    """(query_id, key, fused, rank_dense, rank_sparse) of two ranked lists."""
    both = dense.select("query_id", key, F.col("rank").alias("rank_dense"), F.lit(None).cast("int").alias("rank_sparse")).unionByName(
        sparse.select("query_id", key, F.lit(None).cast("int").alias("rank_dense"), F.col("rank").alias("rank_sparse"))
    )
    share = F.coalesce(1 / (k + F.col("rank_dense")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("rank_sparse")), F.lit(0.0))
    return both.groupBy("query_id", key).agg(F.round(F.sum(share), 9).alias("fused"), F.min("rank_dense").alias("rank_dense"), F.min("rank_sparse").alias("rank_sparse"))



def fused_order(key: str) -> tuple[Column, ...]:
    return F.desc("fused"), F.asc_nulls_last("rank_dense"), F.asc_nulls_last("rank_sparse"), F.col(key)


def capped(ranked: DataFrame, cap: int, k: int, doc: str, *order: Column) -> DataFrame:
    """At most `cap` rows of a document (0: any number), then the k best."""
    if cap:
        ranked = top(ranked, cap, *order, by=("query_id", doc), rank="_own").drop("_own")
    return top(ranked, k, *order)


def hybrid_search(queries: DataFrame, chunks: DataFrame, top_k: int = LIMITS.top_k, mode: str = "hybrid", cap: int = LIMITS.per_document, scope: DataFrame | None = None, kinds: tuple[str, ...] | None = None, key: str = "row_id", doc: str = "doc_id", width: int = LIMITS.candidates) -> DataFrame:
    """(query_id, key, doc, fused, dense_score, rank_dense, rank_sparse, rank): the top_k chunks of each query.

    queries: query_id, text, embedding. chunks: key, doc, text, embedding, and kind where kinds
    are asked for. The lists of both kinds of search hold max(width, 4 * top_k) candidates, or
    all that are allowed, and are fused by rank; mode dense or bm25 takes one of them. What
    scope (query_id, key) and kinds allow is settled before anything is ranked. At most `cap`
    chunks of a document (0: any number). dense_score is the cosine of every hit, of those too
    that only their words have found; null where a vector is missing.
    """
    if mode not in ("hybrid", "dense", "bm25"):
        raise ValueError(f"no such mode: {mode}")
    take = max(width, 4 * top_k)
    live = chunks if kinds is None else chunks.where(F.col("kind").isin(*kinds))
    allowed = scope if kinds is None or scope is None else scope.join(live.select(key), key, "left_semi")
    none = queries.sparkSession.createDataFrame([], queries.select("query_id").join(chunks.select(key)).select("query_id", key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).schema)
    dense = none if mode == "bm25" else cosine(queries, live, take, allowed, key)
    sparse = none if mode == "dense" else bm25(queries, chunks if scope is None and kinds is None else live, take, allowed, key=key)
    hits = capped(rrf(dense, sparse, key).join(chunks.select(key, doc), key), cap, top_k, doc, *fused_order(key))
    told = dense.select("query_id", key, F.col("score").alias("told"))
    met = hits.join(told, ["query_id", key], "left")
    met = met.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id", "left").join(chunks.select(key, F.col("embedding").alias("_e")), key, "left")
    return met.select("query_id", key, doc, "fused", F.coalesce("told", F.round(dot("_q", "_e"), 6)).alias("dense_score"), "rank_dense", "rank_sparse", "rank")


def rescue(hits: DataFrame, least: float = LIMITS.rescue) -> DataFrame:
    """(query_id, rescued) of hits (query_id, dense_score): whether a question that was held for out of scope has a hit that is near enough."""
    return hits.groupBy("query_id").agg((F.coalesce(F.max("dense_score"), F.lit(-1.0)) >= least).alias("rescued"))


def fuse(lists: DataFrame, k: int, cap: int, key: str, doc: str) -> DataFrame:
    """lists (query_id, variant, rank, dense_score, key, doc): one list stays as it is; several fuse by rank, the best dense score of each hit counts."""
    many = lists.groupBy("query_id").agg(F.count_distinct("variant").alias("variants"))
    merged = lists.groupBy("query_id", key, doc).agg(F.round(F.sum(1 / (LIMITS.rrf_k + F.col("rank"))), 9).alias("fused"), F.max("dense_score").alias("dense_score"), F.min("rank").alias("best_rank")).join(many, "query_id")
    order = (F.when(F.col("variants") == 1, F.col("best_rank")), F.desc("fused"), F.col("best_rank"), F.col(key))
    single = top(merged.where("variants = 1"), k, *order)
    return single.unionByName(capped(merged.where("variants > 1"), cap, k, doc, *order)).drop("variants")


def scope_cap(scope: DataFrame) -> DataFrame:
    return scope.groupBy("query_id").agg(F.greatest(F.lit(3), F.ceil(F.lit(24) / F.count_distinct("doc_id"))).alias("cap"))


def char_budget(hits: DataFrame, budget: int = LIMITS.context_chars, floor: int = LIMITS.context_floor) -> DataFrame:
    """hits (query_id, rank, chars): the first `floor`, and those before which fewer than `budget` characters stand."""
    before = F.coalesce(F.sum("chars").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hits.withColumn("before", before).where((F.col("rank") <= floor) | (F.col("before") < budget))


def neighbours(hits: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """(query_id, doc_id, ordinal) next to hits and not held already."""
    near = hits.select("query_id", "doc_id", F.explode(F.sequence(F.col("ordinal") - width, F.col("ordinal") + width)).alias("ordinal")).distinct()
    return near.join(hits, ["query_id", "doc_id", "ordinal"], "left_anti").join(chunks.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_semi")


def first_fit(items: DataFrame, budget: int) -> DataFrame:
    """items (query_id, pos, chars): in order, those that still fit; one that doesn't is skipped. A query's items are few."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def add(s: Column, x: Column) -> Column:
        fits = s["used"] + x["chars"] <= budget
        return F.struct(F.when(fits, s["used"] + x["chars"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["kept"], F.array(x["pos"]))).otherwise(s["kept"]).alias("kept"))

    rows = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("chars").cast("long").alias("chars")))).alias("xs"))
    return rows.select("query_id", F.explode(F.aggregate("xs", zero, add)["kept"]).alias("pos"))


def full_read_route(scoped: DataFrame, single: int = LIMITS.full_read_chars, cross: int = LIMITS.window_chars, most_docs: int = 8) -> DataFrame:
    """scoped (query_id, doc_id, chars, cross_document): whether a query's whole scope is read instead of searched."""
    sums = scoped.groupBy("query_id", "cross_document").agg(F.sum("chars").alias("chars"), F.count_distinct("doc_id").alias("docs"))
    fits = F.when(F.col("cross_document"), (F.col("chars") <= cross) & (F.col("docs") <= most_docs)).otherwise(F.col("chars") <= single)
    return sums.withColumn("route", F.when(fits, "read").otherwise("search"))


def permitted(docs: DataFrame) -> DataFrame:
    """(doc_id, owner_id, shared) of live documents: what scope and lists are told by, without a row for every user of a shared one."""
    return docs.where("status <> 'deleted'").select("doc_id", "owner_id", (F.col("visibility") == "ortak").alias("shared"))


def document_list(docs: DataFrame, users: DataFrame, newest: int = 60) -> DataFrame:
    """(user_id, doc_id, kind, rank): the newest live documents that each user owns or all share, own ones told from shared ones.

    Of shared documents only the `newest` of all can be among a user's newest, so no more of them meet a user.
    """
    live = permitted(docs)
    users = users.select("user_id").distinct()
    own = top(live.select(F.col("owner_id").alias("user_id"), "doc_id"), newest, F.desc("doc_id"), by=("user_id",)).select("user_id", "doc_id", F.lit("own").alias("kind")).join(users, "user_id", "left_semi")
    shared = live.where("shared").orderBy(F.desc("doc_id")).limit(newest)
    others = users.join(F.broadcast(shared), F.col("user_id") != F.col("owner_id")).select("user_id", "doc_id", F.lit("shared").alias("kind"))
    return top(own.unionByName(others), newest, F.desc("doc_id"), by=("user_id",))


def scoped(queries: DataFrame, named: DataFrame, permitted: DataFrame) -> DataFrame:
    """(query_id, doc_id): what a query (query_id, user_id) names, if anything, within what its user may see; nothing left means no hits.

    Named documents are looked up one by one. Only a query that names none gets a row for every
    document that its user owns or all share, as that is its scope.
    """
    asks = named.select("query_id", "doc_id").distinct().join(queries.select("query_id", "user_id"), "query_id")
    found = asks.join(permitted, "doc_id").where(F.col("shared") | (F.col("owner_id") == F.col("user_id"))).select("query_id", "doc_id")
    free = queries.join(named.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "user_id")
    own = free.join(permitted.where("NOT shared"), F.col("user_id") == F.col("owner_id")).select("query_id", "doc_id")
    shared = free.select("query_id").join(permitted.where("shared").select("doc_id"), F.lit(True))
    return found.unionByName(own).unionByName(shared)


def valid_refs(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs (query_id, raw array<string>): (query_id, pos, doc_id) of ready documents in order, each once."""
    ids = refs.select("query_id", F.posexplode("raw").alias("pos", "r")).select("query_id", "pos", F.col("r").try_cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    first = ids.groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"))
    return first.join(docs.where("status = 'ready'").select("doc_id"), "doc_id", "left_semi").select("query_id", "pos", "doc_id")


def normalized(c: Column) -> Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x / norm))


def feedback_vectors(hits: DataFrame, chunks: DataFrame, queries: DataFrame, key: str = "vec_id", weight: float = 0.3, top_n: int = 3) -> DataFrame:
    """(query_id, embedding): each query moved towards the mean of its first hits; a query without hits stays out."""
    dims = hits.where(F.col("rank") <= top_n).join(chunks.select(key, "embedding"), key).select("query_id", F.posexplode("embedding").alias("d", "x"))
    mean = dims.groupBy("query_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    moved = F.zip_with("embedding", "mean", lambda q, m: (1 - weight) * q.cast("double") + weight * m)
    return queries.join(mean, "query_id").select("query_id", normalized(moved).alias("embedding")).where("embedding IS NOT NULL")


def grade_bands(hits: DataFrame, floor: float = LIMITS.score_floor, sure: float = LIMITS.score_sure) -> DataFrame:
    s = F.col("dense_score")
    return hits.withColumn("band", F.when(s < floor, "drop").when(s >= sure, "sure").otherwise("grade"))


def apply_grades(banded: DataFrame, grades: DataFrame) -> DataFrame:
    """banded (query_id, idx, dense_score, band), grades (query_id, idx, relevant, score): kept hits in their new order.

    Sure hits come first by cosine, then graded ones by grade; a query without any grade keeps all.
    """
    live = banded.where("band <> 'drop'")
    any_ = grades.select("query_id").distinct().withColumn("graded", F.lit(True))
    met = live.join(grades.select("query_id", "idx", "relevant", F.coalesce("score", F.lit(0.5)).alias("grade")), ["query_id", "idx"], "left").join(any_, "query_id", "left")
    kept = met.where((F.col("band") == "sure") | F.col("graded").isNull() | F.col("relevant"))
    order = Window.partitionBy("query_id").orderBy((F.col("band") == "sure").desc(), F.desc(F.when(F.col("band") == "sure", F.col("dense_score")).otherwise(F.col("grade"))), "idx")
    return kept.withColumn("position", F.row_number().over(order)).select("query_id", "idx", "band", "position")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """attempts (query_id, attempt, hits): the last, unless an earlier one has more hits; then the earliest of the most."""
    last = F.max_by("hits", "attempt")
    earliest = F.max_by("attempt", F.struct("hits", -F.col("attempt")))
    return attempts.groupBy("query_id").agg(F.when(F.max("hits") > last, earliest).otherwise(F.max("attempt")).alias("attempt"))


def query_variants(queries: DataFrame) -> DataFrame:
    """Search form and full form of each query, once if they are alike."""
    both = queries.select("query_id", F.lit(0).alias("v"), F.col("search").alias("text")).unionByName(queries.select("query_id", F.lit(1).alias("v"), F.col("full").alias("text")))
    one = Window.partitionBy("query_id", X.tr_lower(F.col("text"))).orderBy("v")
    return both.where("trim(text) <> ''").withColumn("r", F.row_number().over(one)).where("r = 1").select("query_id", "v", "text")


def term_hints(queries: DataFrame, targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, term, doc_id, pages): names and codes of a query that its target documents lack and others hold whole, and the pages where they do.

    chunks: doc_id, page_no, text.
    """
    words = F.transform(F.regexp_extract_all("text", F.lit(r"(?U)([\w/-]+(?:['’]\w+)?)"), F.lit(1)), lambda w: F.regexp_extract(w, "^([^'’]*)", 1))
    low = F.transform("words", F.lower)
    first = F.filter("words", lambda w, i: F.array_position(low, F.lower(w)) == i + 1)  # the first spelling of a term counts
    terms = queries.select("query_id", words.alias("words")).select("query_id", F.explode(first).alias("term")).where((F.length("term") >= 2) & F.col("term").rlike(r"^\p{Lu}|\p{Nd}") & ~F.col("term").rlike(r"^\p{Nd}+$"))
    parts = terms.withColumn("ts", F.array_distinct(X.tokenize(F.col("term")))).where(F.size("ts") > 0).select("query_id", "term", F.size("ts").alias("need"), F.explode("ts").alias("token"))
    held = chunks.select("doc_id", "page_no", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("token"))
    held = held.join(parts.select("token").distinct(), "token", "left_semi")
    on_page = parts.join(held, "token").groupBy("query_id", "term", "need", "doc_id", "page_no").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    docs = on_page.groupBy("query_id", "term", "doc_id").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))
    covered = docs.join(targets, ["query_id", "doc_id"], "left_semi").select("query_id", "term").distinct()
    return docs.join(covered, ["query_id", "term"], "left_anti")


def fewshot(queries: DataFrame, feedback: DataFrame, n: int = 5, least: float = LIMITS.fewshot, newest: int = 200) -> DataFrame:
    """The most alike of the newest instructive votes (id, vote, predicted, corrected, embedding)."""
    told = feedback.where("(vote = -1 AND corrected IS NOT NULL) OR (vote = 1 AND predicted IS NOT NULL)").orderBy(F.desc("id")).limit(newest)
    met = queries.select("query_id", F.col("embedding").alias("q")).join(F.broadcast(told), F.lit(True)).withColumn("score", F.round(dot("q", "embedding"), 6)).where(F.col("score") >= least)
    return top(met, n, F.desc("score"), F.col("id")).select("query_id", "rank", "id", F.coalesce("corrected", "predicted").alias("category"), "score")


def per_document(queries: DataFrame, chunks: DataFrame, key: str, doc: str, each: int = 3, most_docs: int = 8) -> DataFrame:
    """(query_id, doc, key, score, rank): the `each` best chunks in each of the `most_docs` documents that fit a query best (queries: query_id, embedding).

    The documents are found as cosine() finds chunks; only chunks of those are scored again,
    where they lie, and each task keeps its own `each` best of a query and document.
    """
    picked = top(nearest(queries, chunks, most_docs, doc).groupBy("query_id", doc).agg(F.max("score").alias("best")), most_docs, F.desc("best"), F.col(doc)).select("query_id", doc)
    scored = nearest_within(queries, chunks, picked, each, key, doc)
    return top(scored, each, F.desc("score"), F.col(key), by=("query_id", doc))
