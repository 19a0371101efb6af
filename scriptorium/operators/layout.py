"""Page structure: lines, headings, repeated edges, label runs, columns, tables, figures.

Pages are rows (doc_id, page_no, text); lines are rows (doc_id, page_no, line_no, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import folds as Z

EDGE = 3
LABEL_RUN, LABEL_CHARS = 3, 40
#: Words whose pages one task looks at, about.
WORDS = 1 << 20


def page_lines(pages: DataFrame) -> DataFrame:
    """Non-blank lines in order, numbered from 1; parsed inside each row, so nothing shuffles."""
    kept = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    return pages.select("doc_id", "page_no", F.posexplode(kept).alias("i", "line")).select("doc_id", "page_no", (F.col("i") + 1).alias("line_no"), "line")


def headings(lines: DataFrame) -> DataFrame:
    return lines.withColumn("heading", X.heading(F.col("line")))


def weight_headings(chars: DataFrame) -> DataFrame:
    """Lines set in a heavier face than their page's body. chars: (doc_id, page_no, line_no, ch, weight)."""
    body = chars.where("weight > 0").groupBy("doc_id", "page_no").agg(F.mode("weight", True).alias("body"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "")
    lines = chars.groupBy("doc_id", "page_no", "line_no").agg(F.median("weight").alias("face"), whole.alias("line")).withColumn("line", X.strip(F.col("line")))
    words = F.size(F.split("line", r"(?U)\s+"))
    fits = (F.col("face") >= F.col("body") + 100) & (X.letters_in(F.col("line")) >= 3) & (words <= 12) & ~F.col("line").rlike(r"[.,;:]$") & ~F.col("line").rlike(r"^[•▪‣·*-]")
    return lines.join(body, ["doc_id", "page_no"]).where(fits).select("doc_id", "page_no", "line_no", "line")


def edge_lines(pages: DataFrame, *more: str, edge: int = EDGE) -> DataFrame:
    """page_lines with whether a line is among the first or last of its page, and its key. more: other columns of the pages."""
    kept = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    cut = pages.select("doc_id", "page_no", *more, kept.alias("kept")).withColumn("n", F.size("kept"))
    lines = cut.select("doc_id", "page_no", *more, "n", F.posexplode("kept").alias("i", "line"))
    near = (F.col("i") < edge) | (F.col("i") >= F.col("n") - edge)
    return lines.select("doc_id", "page_no", *more, (F.col("i") + 1).alias("line_no"), "line", near.alias("edge"), F.when(near, X.edge_key(F.col("line"))).alias("key"))


def repeated_edges(pages: DataFrame) -> DataFrame:
    """(doc_id, key, pages): page headers and footers that at least half of a document's pages, and two, repeat."""
    full = pages.where(F.col("text").rlike(r"(?U)\S")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    keys = edge_lines(pages).where("edge AND key <> ''").select("doc_id", "page_no", "key").distinct()
    counted = keys.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("pages")).join(full, "doc_id")
    return counted.where((F.col("n") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2)))).select("doc_id", "key", "pages")


def strip_edges(pages: DataFrame) -> DataFrame:
    """page_lines without edge lines that are a page number or a repeated header or footer.

    A document's repeated keys are few and meet its whole pages, so texts move once, by document;
    what follows by document or page finds them where they lie.
    """
    known = repeated_edges(pages).groupBy("doc_id").agg(F.collect_set("key").alias("known"))
    lines = edge_lines(pages.join(known, "doc_id", "left"), "known")
    lost = F.col("edge") & (F.col("line").rlike(X.PAGE_NUMBER) | F.coalesce(F.array_contains("known", F.col("key")), F.lit(False)))
    return lines.where(~lost).select("doc_id", "page_no", "line_no", "line")


def hard_split(c, most: int):
    """Pieces of at most `most` characters, cut between words; a longer word is a piece of its own.

    A piece is the longest stretch from one word's begin to another's end that fits, so the
    expression engine finds all pieces in one pass.
    """
    words = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    piece = rf"[^ ](?:.{{0,{most - 2}}}[^ ])?(?![^ ])|[^ ]+" if most > 1 else "[^ ]+"
    return F.regexp_extract_all(words, F.lit(f"(?s){piece}"), F.lit(0))


def units(lines: DataFrame, most: int) -> DataFrame:
    """(doc_id, page_no, line_no, part, text, heading): headings, short lines, sentences, and pieces of long sentences."""
    told = lines.select("doc_id", "page_no", "line_no", "line", X.heading(F.col("line")).alias("heading"))  # once a line: beside the explode it would be told for each part
    sentences = F.split("line", r"(?<=[.!?])\s+")
    pieces = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(hard_split(s, most))))
    cut = F.when(F.col("heading").isNotNull() | (F.length("line") <= most), F.array("line")).otherwise(pieces)
    return told.select("doc_id", "page_no", "line_no", "heading", F.posexplode(cut).alias("part", "text")).select("doc_id", "page_no", "line_no", "part", "text", "heading")


def label_runs(units: DataFrame, run: int = LABEL_RUN, chars: int = LABEL_CHARS) -> DataFrame:
    """units with at least `run` short headings in a row, on one page, joined into one body unit."""
    order = Window.partitionBy("doc_id", "page_no").orderBy("line_no", "part", "text", "heading").rowsBetween(Window.unboundedPreceding, 0)
    short = F.col("heading").isNotNull() & (F.length("text") <= chars)
    marked = units.withColumn("short", short).withColumn("island", F.row_number().over(order) - F.sum(short.cast("int")).over(order))
    # headings of one run share an island; other units have one each
    at = F.concat_ws("/", "line_no", "part")
    key = F.when(F.col("short"), F.concat(F.lit("run "), "island")).otherwise(at)
    item = F.struct("line_no", "part", "text", "heading")
    grouped = marked.groupBy("doc_id", "page_no", key.alias("key")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("short").alias("short"))
    flat = lambda x: F.regexp_replace(x["text"], r"(?U)\s+", " ")
    joined = F.concat(F.lit("[şema/kutu etiketleri: "), F.array_join(F.transform("items", flat), " · "), F.lit("]"))
    one = F.struct(F.col("items")[0]["line_no"].alias("line_no"), F.col("items")[0]["part"].alias("part"), joined.alias("text"), F.lit(None).cast("string").alias("heading"))
    out = F.when(F.col("short") & (F.size("items") >= run), F.array(one)).otherwise(F.col("items"))
    return grouped.select("doc_id", "page_no", F.explode(out).alias("u")).select("doc_id", "page_no", "u.*")


def column_boundary(words: DataFrame, sizes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(page_id, boundary): x of the gutter of two-column pages. words: (page_id, text, x0, x1, top, bottom); sizes: (page_id, width).

    Pages are dealt over `tasks`; None: as many as their words ask for. What moves shrinks so much on
    the wire that partitions joined by their bytes there would be many times as large in a task's memory.

    Candidates stand every max(2, width / 150) between 30 and 70 % of the width. What a candidate
    sees changes only at the first one right of a word's begin and at the first one not left of
    its end, so each word gives these two events; running sums over a page's events say how many
    words began, ended and lie open. Between events nothing changes, and of equal candidates the
    leftmost wins, so no other candidate is looked at. Words without edges count for nothing.
    """
    step = F.greatest(F.lit(2.0), F.col("width") / 150)
    last = F.floor(F.col("width") * 0.4 / step).cast("int")
    at = lambda i: F.col("width") * 0.3 + i * step

    def first(edge: str, beyond) -> Column:
        """The first candidate that is beyond an edge; the division finds it but for rounding."""
        guess = F.greatest(F.lit(-1), F.least(last, F.floor((F.col(edge) - F.col("width") * 0.3) / step).cast("int")))
        near = F.when(beyond(at(guess)), guess).when(beyond(at(guess + 1)), guess + 1).otherwise(guess + 2)
        return F.greatest(F.lit(0), F.least(last + 1, near))

    begun, ended = first("x0", lambda x: x > F.col("x0")), first("x1", lambda x: x >= F.col("x1"))
    edges = words.where("x0 IS NOT NULL AND x1 IS NOT NULL").select("page_id", "x0", "x1")
    tasks = tasks or max(1, -(-edges.count() // WORDS))
    placed = edges.repartition(tasks, "page_id").join(sizes.repartition(tasks, "page_id"), "page_id").select("page_id", "width", "x0", "x1", begun.alias("a"), ended.alias("b"))
    opens, none = (F.col("a") < F.col("b")).cast("int"), F.lit(None).cast("double")
    event = lambda i, start, end, change, l, r: F.struct(F.col(i).alias("i"), F.lit(start).alias("begun"), F.lit(end).alias("ended"), change.alias("open"), l.alias("l"), r.alias("r"))
    both = F.array(event("a", 1, 0, opens, none, F.col("x0")), event("b", 0, 1, -opens, F.col("x1"), none))
    events = placed.select("page_id", "width", F.explode(both).alias("e")).groupBy("page_id", "width", "e.i")
    summed = events.agg(F.sum("e.begun").alias("begun"), F.sum("e.ended").alias("ended"), F.sum("e.open").alias("open"), F.max("e.l").alias("l"), F.min("e.r").alias("r"))
    page = Window.partitionBy("page_id")
    sofar, later = page.orderBy("i").rowsBetween(Window.unboundedPreceding, 0), page.orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    n = F.sum("begun").over(page)
    seen = summed.select(
        "page_id", "i", last.alias("last"), at(F.col("i")).alias("x"), n.alias("n"), F.sum("open").over(sofar).alias("crossing"), F.sum("ended").over(sofar).alias("left"),
        (n - F.sum("begun").over(sofar)).alias("right"), (F.min("r").over(later) - F.max("l").over(sofar)).alias("gap"),
    )
    fits = (F.col("n") >= 20) & (F.col("i") <= F.col("last")) & (F.col("crossing") <= F.greatest(F.lit(2.0), F.col("n") * 0.02)) & (F.least("left", "right") >= F.col("n") * 0.15) & (F.col("gap") >= 12)
    return seen.where(fits).groupBy("page_id").agg(F.max_by("x", F.struct(F.round("gap", 6), -F.col("x"))).alias("boundary"))


def reading_order(words: DataFrame, bounds: DataFrame, near: float = 3.0) -> DataFrame:
    """(page_id, text): words of two-column pages, band by band, left column first; full-width words part the bands."""
    met = words.join(bounds, "page_id").withColumn("wide", (F.col("x0") < F.col("boundary")) & (F.col("x1") > F.col("boundary")))
    order = Window.partitionBy("page_id").orderBy("top", "x0").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.max(F.when(F.col("wide"), F.round("top"))).over(order)
    banded = met.withColumn("band", F.coalesce(cut, F.lit(-1.0))).withColumn("side", F.when(F.col("wide"), 0).when(F.col("x1") <= F.col("boundary"), 1).otherwise(2))
    column = banded.groupBy("page_id", "band", "side").agg(F.collect_list(F.struct("top", "x0", "text")).alias("ws")).withColumn("t", Z.lines(F.col("ws"), near))
    return column.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "side", "t"))), lambda c: c["t"]), "\n").alias("text"))


def outside_tables(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre no table box (page_id, left, right, upper, lower) holds."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = (words["page_id"] == boxes["page_id"]) & x.between(F.col("left"), F.col("right")) & y.between(F.col("upper"), F.col("lower"))
    return words.join(boxes, inside, "left_anti")


def markdown(cells: DataFrame) -> DataFrame:
    """(table_id, markdown) of cells (table_id, row, col, cell): empty rows go; tables under two rows or columns are none."""
    said = F.replace(F.regexp_replace(X.strip(F.coalesce("cell", F.lit(""))), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    width = cells.groupBy("table_id").agg((F.max("col") + 1).alias("width"))
    rows = cells.withColumn("said", said).groupBy("table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "said"))).alias("m"), F.max(F.length("said")).alias("longest")).where("longest > 0")
    filled = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit("")))
    lines = rows.join(width, "table_id").where("width >= 2").select("table_id", "width", "row", F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |")).alias("line"))
    whole = lines.groupBy("table_id", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("all")).where(F.size("all") >= 2)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width").cast("int")))
    return whole.select("table_id", F.array_join(F.concat(F.slice("all", 1, 1), F.array(rule), F.slice("all", F.lit(2), F.size("all"))), "\n").alias("markdown"))


def figure_pages(objects: DataFrame, limit: int = 20) -> DataFrame:
    """Pages that hold a figure, the best of each document. objects: (doc_id, page_no, image_share, strokes, source)."""
    score = F.col("image_share") + F.col("strokes") / 200
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("page_no")))
    fits = (F.col("source") != "ocr") & ((F.col("image_share") >= 0.08) | (F.col("strokes") >= 25))
    return objects.where(fits).withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= limit).select("doc_id", "page_no", "score", "rank")
