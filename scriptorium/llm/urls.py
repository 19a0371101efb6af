"""URL filtering: explicit rules, then a tree of path templates judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Levels of the tree whatever the labels, literal children a node keeps, and their least share beyond that.
DEPTH, FANOUT, LEAST_SHARE = 5, 24, 0.02
#: Standard errors within which a branch counts as like its siblings, and labels under which it can't be told.
ALIKE, FEW_LABELS = 2.0, 5
#: Rows that a prior counts for, and the purity under which a template is rejected.
STRENGTH, LEAST_PURITY = 20.0, 0.5


def host_of(url: Column) -> Column:
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    return F.when(url.contains("://"), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; rules: (allow or block, host with path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Path segments with numbers, hexadecimal ids and very long ones generalised."""

    def general(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        bare = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        kind = F.when(bare.rlike(r"^[0-9]+$"), "{n}").when(bare.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "{x}").when(F.length(s) > 60, "{s}")
        return F.when(kind.isNull(), s).otherwise(F.concat(kind, ending))

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def _put(array: Column, level: int, value: str) -> Column:
    return F.transform(array, lambda s, i: F.when(i == level, F.lit(value)).otherwise(s))


def _away(l: Column, g: Column, pool_l: Column, pool_g: Column) -> Column:
    """Standard errors between the labels of a branch and those of a pool that it belongs to."""
    p = (pool_g + 1) / (pool_l + 2)
    return F.abs(g - l * p) / F.sqrt(F.greatest(F.lit(1e-9), l * p * (1 - p)))


def _widen(rows: DataFrame, level: int) -> DataFrame:
    """Replaces the segment of a level by * where its node has more than FANOUT children, and this one is rare and has few labels or such as agree with those of all rare ones."""
    node = F.concat_ws("/", F.slice("template", 1, level)) if level else F.lit("")
    here = rows.withColumn("node", node).withColumn("seg", F.get("template", F.lit(level)))
    children = here.where("seg IS NOT NULL").groupBy("host", "node", "seg").agg(F.sum("n").alias("own"), F.sum("labelled").alias("l"), F.sum("good").alias("g"))
    nodes = children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("children"), F.sum("own").alias("all")).where(F.col("children") > FANOUT)
    rare = children.join(nodes, ["host", "node"]).where(F.col("own") < LEAST_SHARE * F.col("all")).select("host", "node", "seg", "l", "g")
    pool = rare.groupBy("host", "node").agg(F.sum("l").alias("pool_l"), F.sum("g").alias("pool_g"))
    away = _away(F.col("l"), F.col("g"), F.col("pool_l"), F.col("pool_g"))
    rare = rare.join(pool, ["host", "node"]).where((F.col("l") < FEW_LABELS) | (away <= ALIKE)).select("host", "node", "seg", F.lit(True).alias("rare"))
    met = here.join(materialize(rare, "rare-segments"), ["host", "node", "seg"], "left")  # read anew, so that a hot node's rows can be split
    return met.withColumn("template", F.when(F.col("rare"), _put(F.col("template"), level, "*")).otherwise(F.col("template"))).select(*rows.columns)


def _close(rows: DataFrame, level: int) -> DataFrame:
    """Makes what follows a level one {rest} where the labels below can't differ: all alike, or too few."""
    deep = rows.withColumn("node", F.concat_ws("/", F.slice("template", 1, level + 1))).withColumn("deep", F.size("template") > level + 2)
    nodes = deep.where("deep").groupBy("host", "node").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"))
    alike = nodes.where((F.col("l") < FEW_LABELS) | (F.col("g") == 0) | (F.col("g") == F.col("l"))).select("host", "node", F.lit(True).alias("alike"))
    met = deep.join(materialize(alike, "alike-nodes"), ["host", "node"], "left")
    short = F.concat(F.slice("template", 1, level + 1), F.array(F.lit("{rest}")))
    return met.withColumn("template", F.when(F.col("deep") & F.col("alike"), short).otherwise(F.col("template"))).select(*rows.columns)


def _merge(rows: DataFrame, level: int) -> DataFrame:
    """Joins branches that differ at one level only and whose labels agree with what they hold together."""
    wide = rows.withColumn("wide", _put(F.col("template"), level, "*"))
    own = wide.where(F.size("template") > level).groupBy("host", "wide", "template").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"))
    pool = own.groupBy("host", "wide").agg(F.sum("l").alias("pool_l"), F.sum("g").alias("pool_g"), F.count(F.lit(1)).alias("branches")).where("branches > 1")
    away = _away(F.col("l"), F.col("g"), F.col("pool_l"), F.col("pool_g"))
    alike = own.join(pool, ["host", "wide"]).where((F.col("l") == 0) | (away <= ALIKE)).select("host", "template", F.lit(True).alias("alike"))
    met = wide.join(materialize(alike, "alike-branches"), ["host", "template"], "left")
    return met.withColumn("template", F.when(F.col("alike"), F.col("wide")).otherwise(F.col("template"))).select(*rows.columns)


def templates(pages: DataFrame) -> DataFrame:
    """(host, segs, template, purity) of every host and generalised path of pages (host, segs, label).

    label: true, false, or null where there is none. Beyond DEPTH segments a path is followed as
    far as nodes with labels of both kinds go, a few jobs a level. Purity is smoothed towards the host's,
    which is smoothed towards that of all pages.
    """
    rows = pages.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.count_if("label").alias("good"))
    rows = materialize(rows.withColumn("template", F.col("segs")), "templates")
    levels = 0
    while levels < (rows.agg(F.max(F.size("template"))).first()[0] or 0):  # to the longest path whose nodes differ
        wide = _widen(rows, levels)
        rows = materialize(_close(materialize(wide, "templates"), levels) if levels >= DEPTH - 2 else wide, "templates")
        levels += 1
    for level in reversed(range(levels)):
        rows = materialize(_merge(rows, level), "templates")
    whole = rows.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")).first()
    prior = ((whole.g or 0) + 1.0) / ((whole.l or 0) + 2.0)
    hosts = rows.groupBy("host").agg(((F.sum("good") + STRENGTH * prior) / (F.sum("labelled") + STRENGTH)).alias("host_purity"))
    sums = rows.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")).join(materialize(hosts, "host-purity"), "host")
    pure = sums.select("host", "template", ((F.col("g") + STRENGTH * F.col("host_purity")) / (F.col("l") + STRENGTH)).alias("purity"))
    return rows.join(materialize(pure, "template-purity"), ["host", "template"]).select("host", "segs", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every page.

    pages: id and url. labels: (label_id, label boolean); label_id is what a page's last path
    segment starts with, a number (a page without one has no label). A rule's verdict counts;
    without one, a template under LEAST_PURITY is blocked. A null url, or one without ://, has
    an empty host and path and is judged as such. Rows that repeat an id or url all stay; an
    id with several labels has them all count as bad if one is; an empty table gives no rows.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    parsed = materialize(parsed.withColumn("segs", segments(F.col("path"))), "urls")
    marks = labels.where("label_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("label_id").alias("number")).agg(F.bool_and("label").alias("label"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})[^/]*/?$', 1), '') AS BIGINT)")
    marked = parsed.withColumn("number", number).join(marks, "number", "left")
    judged = materialize(templates(marked.select("host", "segs", "label")), "judged-paths")
    out = parsed.join(judged, ["host", "segs"])  # a frequent path's rows can be split
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    shape = F.concat(F.lit("/"), F.concat_ws("/", "template"))
    return out.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), shape.alias("template"), "purity")
