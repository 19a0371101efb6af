"""What an answer is made of: citations, context, routing, focus and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import text as X


def _in_document(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, doc_id, kind, page_start, ordinal, …) with n, their document's place by first appearance."""
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_id"))).drop("first")
    return hits.join(numbered, ["query_id", "doc_id"])


def _ordered(*fields):
    return F.array_sort(F.collect_list(F.struct((F.col("kind") != "summary").cast("int").alias("_k"), F.coalesce("page_start", F.lit(0)).alias("_p"), "ordinal", *fields)))


def citations(hits: DataFrame, snippet: int = 1200) -> DataFrame:
    """(query_id, n, doc_id, title, score, passages): one citation a document, its summary first, then in page order."""
    passage = (F.substring("text", 1, snippet).alias("text"), (F.length("text") > snippet).alias("truncated"), "kind", "page_start", X.page_label(F.col("section"), F.col("kind"), F.col("page_start"), F.col("page_end")).alias("place"))
    grouped = _in_document(hits).groupBy("query_id", "n", "doc_id", "title").agg(F.round(F.max("score"), 3).alias("score"), _ordered(*passage).alias("ps"))
    slim = F.transform("ps", lambda p: F.struct(p["place"].alias("place"), p["kind"].alias("kind"), p["page_start"].alias("page_start"), p["text"].alias("text"), p["truncated"].alias("truncated")))
    return grouped.select("query_id", "n", "doc_id", "title", "score", slim.alias("passages"))


def context_text(hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered document blocks in citation order."""
    place = X.page_label(F.col("section"), F.col("kind"), F.col("page_start"), F.col("page_end"))
    line = F.concat(F.lit("  — "), place, F.lit("\n  "), F.col("text"))
    blocks = _in_document(hits).groupBy("query_id", "n", "title").agg(F.array_join(F.transform(_ordered(line.alias("line")), lambda p: p["line"]), "\n").alias("body"))
    block = F.concat(F.lit("["), "n", F.lit("] "), "title", F.lit("\n"), "body")
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def citation_pages(cited: DataFrame) -> DataFrame:
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("passages", lambda p: p["page_start"]), lambda p: p.isNotNull())))
    return cited.select("query_id", "n", F.array_join(pages, ",").alias("pages"), F.size("passages").alias("passages"))


def route_tier(runs: DataFrame, limits=LIMITS) -> DataFrame:
    """runs (…, forced, category, difficulty, tokens) with tier and reasons; a category that needs the strong tier can't be forced below it."""
    cross = F.col("category") == "capraz"
    reasons = F.filter(
        F.array(F.when(cross, F.concat(F.lit("category="), "category")), F.when(F.col("difficulty") >= limits.difficulty, F.concat(F.lit("difficulty="), "difficulty")), F.when(F.col("tokens") > limits.context_tokens, F.concat(F.lit("context="), "tokens"))),
        lambda r: r.isNotNull(),
    )
    forced = F.col("forced").isin("writer", "strong")
    tier = F.when((F.col("forced") == "writer") & cross, "strong").when(forced, F.col("forced")).when(F.size(reasons) > 0, "strong").otherwise("writer")
    why = F.when((F.col("forced") == "writer") & cross, "floor").when(forced, "forced").otherwise(F.array_join(reasons, ", "))
    return runs.withColumn("tier", tier).withColumn("reasons", why)


def apply_focus(queries: DataFrame, named: DataFrame, focus: DataFrame, ready: DataFrame) -> DataFrame:
    """(query_id, category, doc_ids): ready focus documents replace the named ones; one of them makes a cross-document question single."""
    kept = focus.join(ready.select("doc_id"), "doc_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("focused"))
    asked = named.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("own"))
    met = queries.join(kept, "query_id", "left").join(asked, "query_id", "left")
    category = F.when((F.size("focused") == 1) & (F.col("category") == "capraz"), "belge_ici").otherwise(F.col("category"))
    return met.select("query_id", category.alias("category"), F.array_join(F.coalesce("focused", "own", F.array().cast("array<bigint>")), ",").alias("doc_ids"))


def summary_listing(named: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, shown): full summaries of the documents that a query names, and, under a null query_id, the first paragraphs of all ready ones.

    The latter are what a query that names none is shown; they are the same for all, so they come once.
    """
    ready = docs.where("status = 'ready' AND summary IS NOT NULL").select("doc_id", "summary")
    full = named.select("query_id", "doc_id").distinct().join(ready, "doc_id").select("query_id", "doc_id", F.col("summary").alias("shown"))
    return full.unionByName(ready.select(F.lit(None).cast("long").alias("query_id"), "doc_id", X.first_paragraph(F.col("summary")).alias("shown")))


def confidence(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Low if a verdict says not grounded or not sufficient, the budget is used up, or under two hits support it."""
    met = runs.join(verdicts, "run_id", "left")
    low = ~F.coalesce("grounded", F.lit(True)) | ~F.coalesce("sufficient", F.lit(True)) | F.col("breached") | (F.col("hits") < 2)
    return met.select("run_id", F.when(low, "low").otherwise("normal").alias("confidence"))
