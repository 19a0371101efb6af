"""Queries of page structure and chunking. Blocks of ten lines of a document stand for its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as D
from ..operators import layout as L
from ..sources.search_index import buckets_for
from .registry import Tables, query

PAGE_LINES = 10


def cut_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) of documents (doc_id, source, text): ten lines a page, with a head and a foot."""
    lines = F.split("text", "\n")
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / PAGE_LINES).cast("int")), lambda i: F.array_join(F.slice(lines, i * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"))
    head = F.concat(F.lit("Corpus of "), "source", F.lit("\n"))
    foot = F.concat(F.lit("\nsayfa "), (F.col("i") + 1).cast("string"))
    cut = docs.select("doc_id", "source", F.posexplode(block).alias("i", "text"))
    return cut.select("doc_id", (F.col("i") + 1).alias("page_no"), F.concat(head, "text", foot).alias("text"))


def pages(t: Tables) -> DataFrame:
    return cut_pages(t.documents)


PAGES = f"""
b AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
pages AS (SELECT doc_id, i + 1 AS page_no, 'Corpus of ' || source || chr(10) || list_aggregate(ls[i * {PAGE_LINES} + 1:i * {PAGE_LINES} + {PAGE_LINES}], 'string_agg', chr(10)) || chr(10) || 'sayfa ' || (i + 1) AS text
  FROM (SELECT *, unnest(range((len(ls) - 1) // {PAGE_LINES} + 1)) AS i FROM b)),
raw AS (SELECT doc_id, page_no, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', ''))), lambda x: x <> '')) AS line,
  generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', ''))), lambda x: x <> ''), 1) AS line_no FROM pages)
"""
KEY = r"lower(translate(trim(regexp_replace(regexp_replace(line, '(?i)^\s*(sayfa|page)?\s*\d{1,4}\s+|\s+\d{1,4}\s*$', '', 'g'), '\s+', ' ', 'g')), 'İI', 'iı'))"
EDGES = rf"""
e AS (SELECT *, line_no <= 3 OR line_no > max(line_no) OVER (PARTITION BY doc_id, page_no) - 3 AS edge,
  CASE WHEN length(line) > 80 OR len(regexp_split_to_array(line, '\s+')) > 10 OR length(regexp_replace({KEY}, '\P{{L}}+', '', 'g')) < 3 THEN '' ELSE {KEY} END AS key FROM raw),
c AS (SELECT doc_id, key, count(DISTINCT page_no) AS pages FROM e WHERE edge AND key <> '' GROUP BY ALL),
f AS (SELECT doc_id, count(*) AS n FROM pages GROUP BY doc_id),
r AS (SELECT doc_id, key, pages FROM c JOIN f USING (doc_id) WHERE n >= 2 AND pages >= greatest(2, n // 2))
"""


@query(f"WITH {PAGES} SELECT doc_id, page_no::INTEGER AS page_no, line_no::INTEGER AS line_no, line FROM raw")
def page_lines(t: Tables) -> DataFrame:
    return L.page_lines(pages(t))


HEAD = r"""
CASE WHEN length(s) <= 2 OR length(s) >= 90 OR regexp_matches(s, '(?i)(tablo\s*\d|şekil\s*\d|sayfa\s*\d|http|www\.|@|©|tel:|faks|e-posta)') OR regexp_matches(s, '[,;]$') THEN NULL
WHEN regexp_matches(s, '(?i)^\s*(madde|md\.)\s*\d+') THEN list_aggregate(w, 'string_agg', ' ')
WHEN len(w) > 10 THEN NULL
WHEN n <> '' AND NOT s LIKE '%.' THEN CASE WHEN regexp_matches(n, '^\p{L}') AND length(regexp_replace(n, '\P{Nd}+', '', 'g'))::DOUBLE / length(n) < 0.15 THEN list_aggregate(w, 'string_agg', ' ') END
WHEN length(regexp_replace(s, '\P{L}+', '', 'g')) >= 4 AND regexp_matches(s, '\p{Lu}') AND NOT regexp_matches(s, '\p{Ll}') AND len(w) <= 8 AND NOT regexp_matches(s, '[,;/]') AND length(regexp_replace(s, '\P{Nd}+', '', 'g'))::DOUBLE / length(s) < 0.2 THEN list_aggregate(w, 'string_agg', ' ') END
"""
CUT = r"""
cut AS (SELECT *, regexp_split_to_array(s, '\s+') AS w, coalesce(regexp_extract(s, '^\s*(\d+(?:\.\d+){0,3})[.)]?\s+(\S.{1,70})$', 2), '') AS n FROM src)
"""


def _marked_lines(t: Tables) -> DataFrame:
    """All lines, whole; those of some remainders are numbered, set in capitals or made an article."""
    lines = L.page_lines(pages(t))
    kind = F.col("line_no") % 5
    marked = F.when(kind == 1, F.concat(F.col("page_no"), F.lit(".2 "), "line")).when(kind == 2, F.upper(F.replace("line", F.lit("ß"), F.lit("ss")))).when(kind == 3, F.concat(F.lit("7 "), "line", F.lit(" 12345678"))).when(kind == 4, F.concat(F.lit("Madde "), "line_no", F.lit(" "), "line"))
    return lines.withColumn("line", X.strip(F.coalesce(marked, F.col("line"))))


@query(
    rf"""
WITH {PAGES}, src AS (SELECT doc_id, page_no, line_no, trim(CASE line_no % 5 WHEN 1 THEN page_no || '.2 ' || line WHEN 2 THEN upper(replace(line, 'ß', 'ss')) WHEN 3 THEN '7 ' || line || ' 12345678' WHEN 4 THEN 'Madde ' || line_no || ' ' || line ELSE line END) AS s FROM raw), {CUT}
SELECT doc_id, page_no::INTEGER AS page_no, line_no::INTEGER AS line_no, {HEAD} AS heading FROM cut
"""
)
def headings(t: Tables) -> DataFrame:
    return L.headings(_marked_lines(t)).select("doc_id", "page_no", "line_no", "heading")


@query(f"WITH {PAGES}, {EDGES} SELECT doc_id, key, pages FROM r")
def repeated_edges(t: Tables) -> DataFrame:
    return L.repeated_edges(pages(t))


STRIPPED = rf"stripped AS (SELECT e.doc_id, page_no::INTEGER AS page_no, line_no::INTEGER AS line_no, line FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.key = r.key WHERE NOT (edge AND (r.key IS NOT NULL OR regexp_matches(line, '(?i)^[^\p{{L}}\p{{N}}_]*(sayfa|page)?\s*\d{{1,4}}(\s*(/|of|-)\s*\d{{1,4}})?[^\p{{L}}\p{{N}}_]*$'))))"


@query(f"WITH {PAGES}, {EDGES}, {STRIPPED} SELECT * FROM stripped")
def strip_edges(t: Tables) -> DataFrame:
    return L.strip_edges(pages(t))


def split_sql(text: str, most: int) -> str:
    """Words of a text folded into pieces: {{done, now}}, then the list of both."""
    words = f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"
    start = f"list_transform({words}, lambda w: {{'done': []::VARCHAR[], 'now': w}})"
    grown = f"length(a.now) + length(x.now) + 1 <= {most}"
    fold = f"list_reduce({start}, lambda a, x: CASE WHEN {grown} THEN {{'done': a.done, 'now': a.now || ' ' || x.now}} ELSE {{'done': list_append(a.done, a.now), 'now': x.now}} END)"
    return f"CASE WHEN len({words}) = 0 THEN []::VARCHAR[] ELSE list_transform([{fold}], lambda f: list_append(f.done, f.now))[1] END"


@query(f"WITH p AS (SELECT doc_id, {split_sql('text', 400)} AS ps FROM documents) SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INTEGER AS part, unnest(ps) AS piece FROM p")
def hard_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(L.hard_split(F.col("text"), 400)).alias("part", "piece"))


def _units(t: Tables) -> DataFrame:
    return L.units(L.strip_edges(pages(t)), 1200)


UNITS = rf"""
{PAGES}, {EDGES}, {STRIPPED}, src AS (SELECT *, line AS s FROM stripped), {CUT}, h AS (SELECT doc_id, page_no, line_no, line, {HEAD} AS heading FROM cut),
sent AS (SELECT *, CASE WHEN heading IS NOT NULL OR length(line) <= 1200 THEN [line] ELSE string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS ss FROM h),
piece AS (SELECT doc_id, page_no, line_no, heading, flatten(list_transform(ss, lambda s: CASE WHEN heading IS NOT NULL OR length(s) <= 1200 THEN [s] ELSE {split_sql('s', 1200)} END)) AS ps FROM sent),
units AS (SELECT doc_id, page_no, line_no, heading, (generate_subscripts(ps, 1) - 1)::INTEGER AS part, unnest(ps) AS text FROM piece)
"""


@query(f"WITH {UNITS} SELECT doc_id, page_no, line_no, part, text, heading FROM units")
def units(t: Tables) -> DataFrame:
    return _units(t)


@query(
    """
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value < 20 ORDER BY event_id) AS island, value < 20 AS short FROM events),
g AS (SELECT user_id, min(event_id) AS first, count(*) AS n, string_agg(event_type, ' · ' ORDER BY event_id) AS labels FROM e WHERE short GROUP BY user_id, island)
SELECT user_id, first, '[şema/kutu etiketleri: ' || labels || ']' AS text FROM g WHERE n >= 3
"""
)
def label_runs(t: Tables) -> DataFrame:
    short = F.col("value") < 20
    rows = t.events.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("event_id").alias("line_no"), F.lit(0).alias("part"), F.col("event_type").alias("text"), F.when(short, F.col("event_type")).alias("heading"))
    return L.label_runs(rows).where(F.col("text").startswith("[şema")).select(F.col("doc_id").alias("user_id"), F.col("line_no").alias("first"), "text")


TAIL = "CASE WHEN length(a.now) <= 300 THEN a.now WHEN instr(right(a.now, 300), ' ') > 0 THEN substr(right(a.now, 300), instr(right(a.now, 300), ' ') + 1) ELSE right(a.now, 300) END"
FULL = "length(a.now) + length(x.now) > 2400"
CHUNK = "{'section': f.section, 'text': f.now, 'page_start': f.a, 'page_end': f.b}"
LAST = "f.done[len(f.done)]"
ENDED = f"CASE WHEN len(f.done) > 0 AND length(f.now) < 200 THEN list_append(f.done[1:len(f.done) - 1], {{'section': {LAST}.section, 'text': {LAST}.text || ' ' || f.now, 'page_start': {LAST}.page_start, 'page_end': f.b}}) ELSE list_append(f.done, {CHUNK}) END"
NAMES = "list_filter(list_concat(string_split(coalesce(a[len(a)].section, ''), ' · '), string_split(coalesce(x[1].section, ''), ' · ')), lambda n: n <> '')"
OWN = f"list_filter({NAMES}, lambda n, i: list_position({NAMES}, n) = i)"
SECTION = f"coalesce(list_aggregate({OWN}[1:3], 'string_agg', ' · '), '') || CASE WHEN len({OWN}) > 3 THEN ' …' ELSE '' END"
LEADING = "(len(a) = 1 AND length(a[1].text) <= 40)"
PACKED = f"""
{UNITS}, numbered AS (SELECT *, sum((heading IS NOT NULL)::INTEGER) OVER (PARTITION BY doc_id ORDER BY page_no, line_no, part) AS s FROM units),
packed AS (SELECT doc_id, s, list_reduce(list({{'done': []::STRUCT(section VARCHAR, text VARCHAR, page_start INTEGER, page_end INTEGER)[], 'now': text, 'a': page_no, 'b': page_no, 'section': heading}} ORDER BY page_no, line_no, part),
  lambda a, x: {{'done': CASE WHEN {FULL} THEN list_append(a.done, {{'section': a.section, 'text': a.now, 'page_start': a.a, 'page_end': a.b}}) ELSE a.done END,
    'now': CASE WHEN {FULL} THEN {TAIL} ELSE a.now END || ' ' || x.now, 'a': CASE WHEN {FULL} THEN a.b ELSE a.a END, 'b': x.b, 'section': coalesce(a.section, x.section)}}) AS f FROM numbered GROUP BY doc_id, s),
sections AS (SELECT doc_id, flatten(list({ENDED} ORDER BY s)) AS cs FROM packed GROUP BY doc_id)
"""
CRUMBS = f"""
list_reduce(list_transform(cs, lambda c: [c]), lambda a, x: CASE WHEN length(x[1].text) <= 40 OR {LEADING}
  THEN list_append(a[1:len(a) - 1], {{'section': CASE WHEN {LEADING} THEN x[1].section ELSE a[len(a)].section END, 'text': a[len(a)].text || chr(10) || x[1].text, 'page_start': a[len(a)].page_start, 'page_end': x[1].page_end}}) ELSE list_append(a, x[1]) END)
"""
MERGED = f"""
list_reduce(list_transform(cs, lambda c: [c]), lambda a, x: CASE WHEN (length(a[len(a)].text) < 200 OR length(x[1].text) < 200) AND length(a[len(a)].text) + length(x[1].text) + 1 <= 2400
  THEN list_append(a[1:len(a) - 1], {{'section': {SECTION}, 'text': a[len(a)].text || chr(10) || x[1].text, 'page_start': a[len(a)].page_start, 'page_end': x[1].page_end}}) ELSE list_append(a, x[1]) END)
"""


def chunks_sql(cs: str) -> str:
    return f"SELECT doc_id, (generate_subscripts({cs}, 1) - 1)::INTEGER AS ordinal, unnest({cs}).section AS section, unnest({cs}).text AS text, unnest({cs}).page_start AS page_start, unnest({cs}).page_end AS page_end"


def _sections(t: Tables) -> DataFrame:
    return D.sections(_units(t))


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode("cs").alias("ordinal", "c")).select("doc_id", "ordinal", "c.*")


@query(f"WITH {PACKED}, q AS (SELECT doc_id, {CRUMBS} AS cs FROM sections) {chunks_sql('cs')} FROM q")
def chunk_crumbs(t: Tables) -> DataFrame:
    """Packed sections whose crumbs have gone to their neighbours."""
    return _exploded(_sections(t).select("doc_id", D.absorb_crumbs(F.col("cs")).alias("cs")))


@query(f"WITH {PACKED}, q AS (SELECT doc_id, {MERGED} AS cs FROM sections) {chunks_sql('cs')} FROM q")
def chunk_merge(t: Tables) -> DataFrame:
    """Packed sections of which short ones are joined."""
    return _exploded(_sections(t).select("doc_id", D.merge_short(F.col("cs"), 200, 2400).alias("cs")))


@query(f"WITH {PACKED}, p AS (SELECT doc_id, {CRUMBS} AS cs FROM sections), q AS (SELECT doc_id, {MERGED} AS cs FROM p) {chunks_sql('cs')} FROM q")
def chunk_pack(t: Tables) -> DataFrame:
    return D.chunk(_units(t))


WINDOWS = f"""
{PAGES}, p AS (SELECT doc_id, page_no, length(text) AS n FROM pages),
w AS (SELECT doc_id, page_no, n AS size, 0 AS w FROM p WHERE page_no = 1
  UNION ALL SELECT p.doc_id, p.page_no, CASE WHEN w.size > 0 AND w.size + p.n > 3000 THEN p.n ELSE w.size + p.n END, CASE WHEN w.size > 0 AND w.size + p.n > 3000 THEN w.w + 1 ELSE w.w END FROM w JOIN p ON p.doc_id = w.doc_id AND p.page_no = w.page_no + 1)
"""


@query(f'WITH RECURSIVE {WINDOWS} SELECT doc_id, w::INTEGER AS "window", count(*) AS pages, min(page_no)::INTEGER AS first FROM w GROUP BY ALL')
def page_windows(t: Tables) -> DataFrame:
    return D.page_windows(pages(t), 3000).groupBy("doc_id", "window").agg(F.count(F.lit(1)).alias("pages"), F.min("page_no").alias("first"))


@query(
    f"""
WITH RECURSIVE {WINDOWS}, m AS (SELECT doc_id, w, string_agg('=== Sayfa ' || page_no || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS material FROM w JOIN pages USING (doc_id, page_no) GROUP BY ALL)
SELECT doc_id, w::INTEGER AS "window", length(material)::INTEGER AS chars, sha256(material) AS digest FROM m
"""
)
def window_material(t: Tables) -> DataFrame:
    pages_ = pages(t)
    return D.window_material(pages_, D.page_windows(pages_, 3000)).select("doc_id", "window", F.length("material").alias("chars"), F.sha2("material", 256).alias("digest"))


@query(
    """
WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (TRUE) AS raw, list(o_orderpriority ORDER BY o_orderkey) AS names FROM orders GROUP BY 1),
d AS (SELECT o_custkey, list_filter(names, lambda x, i: list_position(names, x) = i) AS own FROM s)
SELECT o_custkey, list_aggregate(own[1:3], 'string_agg', ' · ') || CASE WHEN len(own) > 3 THEN ' …' ELSE '' END AS section FROM d
"""
)
def section_name(t: Tables) -> DataFrame:
    names = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("names"))
    return names.select("o_custkey", D.section_name(F.col("names")).alias("section"))


@query("SELECT doc_id, source || ' — ' || lang || chr(10) || chr(10) || text AS contextual FROM documents")
def chunk_document(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", D.contextual(F.col("source"), F.col("lang"), F.col("text")).alias("contextual"))


@query(
    r"""
WITH c AS (SELECT r_regionkey, n_nationkey % 5 AS col, n_nationkey // 5 AS row, replace(n_name, '_', '|') AS cell FROM nation JOIN region ON r_regionkey = n_regionkey),
g AS (SELECT r_regionkey, row, list_transform(range(w), lambda i: coalesce(list_filter(cs, lambda x: x.col = i)[1].cell, '')) AS cells FROM (
  SELECT r_regionkey, row, list({'col': col, 'cell': replace(cell, '|', '\|')}) AS cs FROM c GROUP BY ALL) JOIN (SELECT r_regionkey, max(col) + 1 AS w FROM c GROUP BY ALL) USING (r_regionkey) WHERE w >= 2),
l AS (SELECT r_regionkey, row, row_number() OVER (PARTITION BY r_regionkey ORDER BY row) AS k, '| ' || list_aggregate(cells, 'string_agg', ' | ') || ' |' AS line, len(cells) AS w FROM g)
SELECT r_regionkey AS table_id, string_agg(line || CASE WHEN k = 1 THEN chr(10) || '|' || repeat(' --- |', w) ELSE '' END, chr(10) ORDER BY row) AS markdown FROM l GROUP BY 1 HAVING count(*) >= 2
"""
)
def markdown_table(t: Tables) -> DataFrame:
    cells = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("r_regionkey").alias("table_id"), (F.col("n_nationkey") % 5).alias("col"), F.floor(F.col("n_nationkey") / 5).alias("row"), F.replace("n_name", F.lit("_"), F.lit("|")).alias("cell")
    )
    return L.markdown(cells)


@query(
    """
WITH o AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id, (length(html) - length(replace(html, '<li', ''))) / 3 * 0.02 AS share, (length(html) - length(replace(html, '<p', ''))) // 2 AS strokes FROM pages),
s AS (SELECT *, share + strokes / 200.0::DOUBLE AS score FROM o WHERE share >= 0.08 OR strokes >= 25),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id DESC) AS rank FROM s)
SELECT host, page_id, rank::INTEGER AS rank FROM r WHERE rank <= 20
"""
)
def figure_pages(t: Tables) -> DataFrame:
    """List items and paragraphs of web pages stand for image area and strokes."""
    times = lambda s: (F.length("html") - F.length(F.replace("html", F.lit(s), F.lit("")))) / len(s)
    objects = t.pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("doc_id"), F.col("page_id").alias("page_no"), (times("<li") * 0.02).alias("image_share"), times("<p").alias("strokes"), F.lit("text").alias("source"))
    return L.figure_pages(objects).select(F.col("doc_id").alias("host"), F.col("page_no").alias("page_id"), "rank")


def _words(t: Tables) -> DataFrame:
    """All words of a document, 60 to a page in two columns under a full-width title; page_id is 1000 * doc_id + page."""
    w = t.documents.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("at", "text")).where("text <> ''")
    i = (F.col("at") % 60).cast("double")
    title, column, row, slot = i < 4, F.floor((i - 4) / 28), F.floor(((i - 4) % 28) / 4), (i - 4) % 4
    x0 = F.when(title, 80 + i * 110).otherwise(60 + column * 260 + slot * 55)
    page = F.col("doc_id") * 1000 + F.floor(F.col("at") / 60)
    return w.select(page.alias("page_id"), "text", x0.alias("x0"), (x0 + F.when(title, 105).otherwise(50)).alias("x1"), F.when(title, 40.0).otherwise(60 + row * 14).alias("top"), F.when(title, 52.0).otherwise(72 + row * 14).alias("bottom"))


WORDS = r"""
w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+')) AS text, generate_subscripts(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), 1) - 1 AS k FROM documents),
z AS (SELECT doc_id * 1000 + k // 60 AS page_id, text, k % 60 AS i FROM w WHERE text <> ''),
v AS (SELECT *, CASE WHEN i < 4 THEN 80 + i * 110 ELSE 60 + (i - 4) // 28 * 260 + (i - 4) % 4 * 55 END::DOUBLE AS x0, CASE WHEN i < 4 THEN 40 ELSE 60 + ((i - 4) % 28) // 4 * 14 END::DOUBLE AS top FROM z),
words AS (SELECT page_id, text, x0, x0 + CASE WHEN i < 4 THEN 105 ELSE 50 END AS x1, top, top + 12 AS bottom FROM v)
"""


BOUNDS = """
n AS (SELECT page_id, count(*) AS n FROM words GROUP BY 1 HAVING count(*) >= 20), x AS (SELECT page_id, n, 180.0::DOUBLE + unnest(range(61)) * 4.0::DOUBLE AS x FROM n),
m AS (SELECT x.page_id, n, x, count(*) FILTER (x0 < x AND x1 > x) AS c, count(*) FILTER (x1 <= x) AS l, count(*) FILTER (x0 >= x) AS r, min(x0) FILTER (x0 >= x) - max(x1) FILTER (x1 <= x) AS gap FROM x JOIN words USING (page_id) GROUP BY ALL),
bounds AS (SELECT page_id, arg_max(x, (round(gap, 6), -x)) AS boundary FROM m WHERE c <= greatest(2, n * 0.02) AND least(l, r) >= n * 0.15 AND gap >= 12 GROUP BY 1)
"""


def _bounds(t: Tables, words: DataFrame) -> DataFrame:
    return L.column_boundary(words, words.select("page_id").distinct().withColumn("width", F.lit(600.0)), buckets_for(t.documents))


@query(f"WITH {WORDS}, {BOUNDS} SELECT * FROM bounds")
def column_boundary(t: Tables) -> DataFrame:
    return _bounds(t, _words(t))


@query(
    f"""
WITH {WORDS}, {BOUNDS}, met AS (SELECT words.*, boundary, x0 < boundary AND x1 > boundary AS wide FROM words JOIN bounds USING (page_id)),
banded AS (SELECT *, coalesce(max(CASE WHEN wide THEN round(top) END) OVER (PARTITION BY page_id ORDER BY top, x0 ROWS UNBOUNDED PRECEDING), -1) AS band, CASE WHEN wide THEN 0 WHEN x1 <= boundary THEN 1 ELSE 2 END AS side FROM met),
folded AS (SELECT page_id, band, side, list_reduce(list({{'anchor': top, 'out': [{{'l': top, 'x': x0, 't': text}}]}} ORDER BY top, x0, text),
  lambda a, w: CASE WHEN w.anchor - a.anchor <= 3 THEN {{'anchor': a.anchor, 'out': list_append(a.out, {{'l': a.anchor, 'x': w.out[1].x, 't': w.out[1].t}})}} ELSE {{'anchor': w.anchor, 'out': list_concat(a.out, w.out)}} END).out AS us FROM banded GROUP BY ALL),
placed AS (SELECT page_id, band, side, unnest(us) AS u FROM folded),
lined AS (SELECT page_id, band, side, u.l AS l, string_agg(u.t, ' ' ORDER BY u.x, u.t) AS line FROM placed GROUP BY ALL)
SELECT page_id, string_agg(line, chr(10) ORDER BY band, side, l) AS text FROM lined GROUP BY 1
"""
)
def reading_order(t: Tables) -> DataFrame:
    words = _words(t)
    return L.reading_order(words, _bounds(t, words))


@query(f"WITH {WORDS} SELECT page_id, count(*) AS n, min(text) AS least FROM words WHERE NOT ((x0 + x1) / 2 BETWEEN 100 AND 300 AND (top + bottom) / 2 BETWEEN 60 + page_id % 3 * 20 AND 120) GROUP BY 1")
def words_outside_tables(t: Tables) -> DataFrame:
    words = _words(t)
    boxes = words.select("page_id").distinct().select("page_id", F.lit(100.0).alias("left"), F.lit(300.0).alias("right"), (60 + F.col("page_id") % 3 * 20).alias("upper"), F.lit(120.0).alias("lower"))
    return L.outside_tables(words, boxes).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("least"))


@query(
    """
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN value > 60 THEN 700 ELSE 400 END AS weight FROM events),
b AS (SELECT user_id, list_sort(list({'n': -n, 'w': weight}))[1].w AS body FROM (SELECT user_id, weight, sum(length(event_type)) AS n FROM c GROUP BY ALL) GROUP BY 1)
SELECT user_id, event_id, event_type AS line FROM c JOIN b USING (user_id) WHERE weight >= body + 100
"""
)
def weight_headings(t: Tables) -> DataFrame:
    """Events stand for lines of a user's page; high values are set in a heavy face."""
    face = F.when(F.col("value") > 60, 700).otherwise(400)
    chars = t.events.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("event_id").alias("line_no"), face.alias("weight"), F.posexplode(F.split("event_type", "")).alias("pos", "ch"))
    return L.weight_headings(chars).select(F.col("doc_id").alias("user_id"), F.col("line_no").alias("event_id"), "line")
