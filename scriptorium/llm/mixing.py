"""Mixing sources to target weights by entropy balancing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Weights of the sources in order, repeating; share of all words the mix takes; times a document is taken at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents of one source that are rounded together, and Newton rounds at most.
GROUP_ROWS, ROUNDS = 1000, 60


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with target: SHARE of all words by weight, none above MOST times its source.

    The excess of a capped source goes to the others by weight until none is above. Sources
    in order of their share of capacity to weight are capped one after the other, so running
    sums over that order give the level at which it ends. There is one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * MOST)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * SHARE
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levelled = rows.withColumn("level", left / F.sum("weight").over(onward)).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())  # of the first that isn't capped; later ones are lower
    met = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return levelled.withColumn("target", met).select("source", "source_size", "target")


def _rate(tilt: str | Column, size: str = "size") -> Column:
    """Times a document is taken on average: exponentially tilted by its words, cut at MOST."""
    t = F.col(tilt) if isinstance(tilt, str) else tilt
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(50.0), t * F.col(size) / F.col("mean"))))


def tilts(cells: DataFrame, targets: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """(source, tilt, mean): the dual variables that make the expected words meet the targets.

    cells: (source, size, n), n documents of a size. Of all rates r with sum(size * r) = target
    and r <= MOST, the one of least relative entropy to taking each document once is
    min(MOST, exp(tilt * size / mean)). Its dual is convex with one variable a source; every
    round sums value and slope over the cells (map-side first) and takes a Newton step, held
    in a bracket that halves where the step leaves it.
    """
    state = targets.where("target > 0 AND source_size > 0").select("source", "target", F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    means = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    same = F.col("source").eqNullSafe(F.col("of"))
    state = state.join(means.withColumnRenamed("source", "of"), same).drop("of")
    state = spent = materialize(state.withColumn("done", F.lit(False)), "tilts")
    for _ in range(ROUNDS):
        live = cells.join(state.where("NOT done").select(F.col("source").alias("of"), "tilt", "mean"), same)
        r = _rate("tilt")
        sums = live.groupBy("of").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("value"),
            F.sum(F.when(r < MOST, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r).otherwise(0.0)).alias("slope"),
        )
        met = state.join(sums, same, "left")
        over, off = F.col("value") > F.col("target"), F.abs(F.col("value") - F.col("target")) / F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.greatest("low", "tilt")), F.when(over, F.least("high", "tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.when(F.col("slope") > 0, (F.col("value") - F.col("target")) / F.col("slope"))
        step = F.greatest(F.col("tilt") - 4, F.least(F.col("tilt") + 4, step))
        bracketed = met.withColumn("l", low).withColumn("h", high).withColumn("step", step)
        middle = F.greatest(F.col("tilt") - 8, F.least(F.col("tilt") + 8, (F.col("l") + F.col("h")) / 2))
        moved = F.when((F.col("step") > F.col("l")) & (F.col("step") < F.col("h")), F.col("step")).otherwise(middle)
        done = F.col("done") | (off < tolerance) | (F.col("h") - F.col("l") < 1e-12) | ((F.col("slope") == 0) & ~over)
        state = bracketed.select("source", "target", F.when(done, F.col("tilt")).otherwise(moved).alias("tilt"), F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high"), "mean", F.coalesce(done, F.lit(True)).alias("done"))
        state = spent = materialize(state, "tilts", spent)
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "tilt", "mean")


def _rounded(docs: DataFrame) -> DataFrame:
    """Copies of each row, from its rate; docs: doc_id, mark, source, size, rows (how many are alike in all of these), group, rate.

    Within a group of about GROUP_ROWS rows, from the longest to the shortest, each document
    takes the number of copies that brings the words taken so far nearest to those expected:
    shorter documents make up for what longer ones leave. Rows that are alike take theirs at
    once, and share them as evenly as whole copies allow.
    """
    own = F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id", "mark").alias("tie"), "doc_id", "mark", "size", "rate", "rows")
    groups = docs.groupBy("source", "group").agg(F.sort_array(F.collect_list(own)).alias("all"))
    zero = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<long>").alias("copies"))

    def take(state: Column, row: Column) -> Column:
        due = state["due"] + row["rate"] * row["size"] * row["rows"]
        copies = F.when(row["size"] > 0, F.greatest(F.lit(0), F.least(MOST * row["rows"], F.floor(due / row["size"] + 0.5)))).otherwise(row["rows"])
        return F.struct((due - copies * row["size"]).alias("due"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    folded = groups.withColumn("copies", F.aggregate("all", zero, take)["copies"])
    each = folded.select("source", F.explode(F.arrays_zip("all", "copies")).alias("z")).select("source", "z.all.doc_id", "z.all.mark", "z.all.size", "z.all.rows", "z.copies")
    even, more = F.floor(F.col("copies") / F.col("rows")), F.pmod("copies", "rows")
    shared = each.withColumn("even", even).withColumn("more", more).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return shared.select("source", "doc_id", "mark", "size", (F.col("even") + (F.col("nth") <= F.col("more")).cast("long")).cast("int").alias("copies"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, mark, source, size, source_size, target, copies) of every row; mark is a hash of its text.

    The size is the number of words (a null text has none). Documents without words are taken
    once, as zero words. A null source is a source of its own, the last in order. Rows that
    repeat an id are documents of their own. An empty table gives no rows; other columns are
    not read. Reruns agree: ties are settled by hashes of a row's own values.

    A source's documents are dealt into groups of about GROUP_ROWS by a hash, so the largest
    source is shared by all tasks; only sums of its words leave them. Rows that repeat both id and
    text are counted first, and each GROUP_ROWS of them are dealt as one.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(source_col).alias("source"), words_in(text).alias("size"))
    sized = materialize(sized, "sizes")
    cells = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-cells")
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sums = materialize(sums, "source-sizes")
    targets = materialize(source_targets(sums.select("source", "source_size")), "targets")
    found = tilts(cells.where("size > 0"), targets)
    same = F.col("source").eqNullSafe(F.col("of"))
    plan = targets.join(found.withColumnRenamed("source", "of"), same, "left").drop("of")
    plan = plan.join(sums.select(F.col("source").alias("of"), "docs"), same).drop("of")
    plan = materialize(plan.select(F.col("source").alias("of"), "source_size", "target", "tilt", "mean", F.ceil(F.col("docs") / GROUP_ROWS).alias("groups")), "mix-plan")
    met = sized.join(plan.select("of", "tilt", "mean", "groups"), same).drop("of")
    alike = met.groupBy("doc_id", "mark", "source", "size", "tilt", "mean", "groups").agg(F.count(F.lit(1)).alias("n"))
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP_ROWS))))
    rows = F.least(F.lit(GROUP_ROWS).cast("long"), F.col("n") - F.col("part") * GROUP_ROWS)
    group = F.pmod(F.xxhash64("doc_id", "mark", "part"), F.col("groups"))
    rated = parts.select("doc_id", "mark", "source", "size", rows.alias("rows"), group.alias("group"), F.coalesce(_rate("tilt"), F.lit(0.0)).alias("rate"))
    return _rounded(rated).join(plan.select("of", "source_size", "target"), same).drop("of")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every document; taken is its words times its copies. See copies()."""
    taken = copies(docs, id_col, text_col, source_col)
    return taken.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, source and others), each as often as the mix takes it. See copies()."""
    many = copies(docs).groupBy("doc_id", "mark").agg(F.sum("copies").alias("times"))
    many = materialize(many.where("times > 0").select(F.col("doc_id").alias("of"), "mark", "times"), "copies")
    row = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))  # the caller's names stay inside
    nth = F.row_number().over(Window.partitionBy("id", "own").orderBy(F.lit(0)))
    once = row.withColumn("nth", nth).where("nth = 1")
    met = once.join(many, F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("mark")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")
