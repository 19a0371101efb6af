"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import Tables, query

STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
LOWER = "lower(translate({0}, 'İI', 'iı'))"
STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS = rf"list_filter(list_transform(regexp_split_to_array(translate({LOWER}, '-/', '  '), '[ \t\n\r\f\x0b]+'), lambda w: regexp_replace(w, '[^\p{{{{L}}}}\p{{{{N}}}}]+', '', 'g')), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column).replace("{{", "{").replace("}}", "}")


@query(
    r"""
SELECT doc_id, trim(list_aggregate(list_transform(string_split(
  regexp_replace(regexp_replace(
    nfc_normalize(translate(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])[\x{00AD}\x{FFFE}][ \t]*\n?[ \t]*([\p{L}\p{N}_])', '\1\2', 'g'), '[\x{00AD}\x{FFFE}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'),
      'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '‐‑‒–—‘’“”', '-----''''""')),
    '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  chr(10)), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), 'string_agg', chr(10)), ' ' || chr(10)) AS cleaned FROM documents
"""
)
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, nfc_normalize(text || chr(10) || 'e' || chr(769) || 'm²½') AS composed FROM documents")
def nfc_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.nfc(F.concat("text", F.lit("\ném²½"))).alias("composed"))


@query()
def valid_text(t: Tables) -> DataFrame:
    damaged = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("EDA080"))).cast("string")
    return t.documents.select("doc_id", X.valid_text(damaged).alias("repaired"), F.is_valid_utf8(X.valid_text(damaged)).alias("valid"))


@query(
    r"""
WITH d AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages),
n AS (SELECT *, regexp_replace(text, '\s+', '', 'g') AS x FROM d)
SELECT kind, id, coalesce(length(regexp_replace(x, '\P{L}+', '', 'g')) < 60 OR length(regexp_replace(x, '\P{L}+', '', 'g'))::DOUBLE / length(x) < 0.5
  OR length(regexp_replace(x, '[^\x{FFFD}]+', '', 'g'))::DOUBLE / length(x) > 0.02, TRUE) AS needs_ocr FROM n
"""
)
def needs_ocr(t: Tables) -> DataFrame:
    docs = t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = t.pages.select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return docs.unionByName(pages).select("kind", "id", X.needs_ocr(F.col("text")).alias("needs_ocr"))


@query(
    r"""
WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS raw, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', '', 'g'), '<[^>]*>', ' ', 'g') AS lay FROM pages)
SELECT page_id, CASE WHEN NOT regexp_matches(raw, '\S') THEN 'layout' WHEN NOT regexp_matches(lay, '\S') OR contains(lay, '(cid:') OR length(lay)::DOUBLE / length(raw) < 0.8 OR length(lay)::DOUBLE / length(raw) > 1.3 THEN 'raw' ELSE 'layout' END AS chosen FROM p
"""
)
def pick_extraction(t: Tables) -> DataFrame:
    raw = F.regexp_replace("html", "<[^>]*>", "")
    layout = F.regexp_replace(F.regexp_replace("html", "<(script|style)[^>]*>[^<]*</(script|style)>", ""), "<[^>]*>", " ")
    return t.pages.select("page_id", raw.alias("raw"), layout.alias("lay")).select("page_id", X.pick_extraction(F.col("raw"), F.col("lay")).alias("chosen"))


@query(f"SELECT doc_id, {LOWER.format('text')} AS low FROM documents UNION ALL SELECT item_id, {LOWER.format("'IĞDIR İZMİR ' || text")} FROM benchmark")
def tr_lower(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", X.tr_lower(F.col("text")).alias("low"))
    return docs.unionByName(t.benchmark.select(F.col("item_id").alias("doc_id"), X.tr_lower(F.concat(F.lit("IĞDIR İZMİR "), "text")).alias("low")))


@query(f"SELECT doc_id, coalesce(list_aggregate({tokens_sql('text')}, 'string_agg', ' '), '') AS terms FROM documents")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("terms"))


@query(
    r"""
WITH s AS (SELECT p_partkey, p_name AS raw FROM part UNION ALL SELECT p_partkey, upper(p_name) || ' A.B. LTD. ISI' FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(raw, '\p{Lu}') AND NOT regexp_matches(raw, '\p{Ll}') THEN list_aggregate(list_transform(string_split(raw, ' '), lambda w:
  CASE WHEN contains(rtrim(w, '.'), '.') THEN w ELSE
    CASE lower(translate(w, 'İI', 'iı'))[1] WHEN 'i' THEN 'İ' WHEN 'ı' THEN 'I' ELSE upper(lower(translate(w, 'İI', 'iı'))[1]) END || lower(translate(w, 'İI', 'iı'))[2:] END), 'string_agg', ' ') ELSE raw END AS titled FROM s
"""
)
def title_case(t: Tables) -> DataFrame:
    raw = t.part.select("p_partkey", F.col("p_name").alias("raw")).unionByName(t.part.select("p_partkey", F.concat(F.upper("p_name"), F.lit(" A.B. LTD. ISI")).alias("raw")))
    return raw.select("p_partkey", X.title_case(F.col("raw")).alias("titled"))


@query(
    r"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'T ' || conv_id ELSE 'file ' || turn END AS title, CASE WHEN turn % 3 = 0 THEN 'K' || turn END AS kind,
       trim(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS body FROM conversations
"""
)
def summary_fields(t: Tables) -> DataFrame:
    labelled = F.concat(
        F.lit("```\n"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Başlık: T "), "conv_id", F.lit("\n"))).otherwise(""),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("tür : K"), "turn", F.lit("\n"))).otherwise(""), "text", F.lit("\n```"),
    )
    fields = X.summary_fields(labelled, F.replace(F.concat(F.lit("file_"), "turn"), F.lit("_"), F.lit(" ")))
    return t.conversations.select("conv_id", "turn", fields.alias("s")).select("conv_id", "turn", "s.title", "s.kind", "s.body")


@query(
    r"""
WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x, text FROM conversations)
SELECT conv_id, turn, CASE WHEN length(x) <= 60 THEN x ELSE coalesce(nullif(regexp_extract(substr(x, 1, 60), '(?s)^(.*) ', 1), ''), substr(x, 1, 60)) || '…' END AS title,
  substr(string_split(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10) || chr(10))[1], 1, 320) AS opening FROM s
"""
)
def conv_title(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.clip_title(F.col("text")).alias("title"), X.first_paragraph(F.col("text")).alias("opening"))


@query("SELECT l_orderkey, l_linenumber, '‰' || CAST(l_quantity AS INTEGER) || ' ve %5 ve ‰ ' || l_linenumber AS fixed FROM lineitem")
def permille_fix(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("%o"), F.col("l_quantity").cast("int"), F.lit(" ve %5 ve ‰o "), "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.permille_fix(raw).alias("fixed"))


@query(
    r"""
WITH s AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS x FROM conversations)
SELECT conv_id, turn, x AS shown FROM s
"""
)
def strip_blocks(t: Tables) -> DataFrame:
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>a\nb</think> "), "text")).otherwise(F.concat("text", F.lit(" <Reasoning x=1>never closed")))
    return t.conversations.select("conv_id", "turn", X.strip_blocks(raw).alias("shown"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 4 = 3 AS listed FROM events")
def extract_json(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.col("props")).when(kind == 2, F.concat(F.lit("it is "), "props", F.lit(" ok"))).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    found = t.events.select("event_id", X.extract_json(raw).alias("v"))
    k = F.coalesce(F.try_variant_get("v", "$.k", "int"), F.try_variant_get("v", "$.items[0].k", "int"))
    return found.select("event_id", k.alias("k"), F.try_variant_get("v", "$.items[0].k", "int").isNotNull().alias("listed"))


@query(
    """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 60.0 * (event_id % 7) + event_id % 50 WHEN 1 THEN (event_id % 900) * 0.001 WHEN 2 THEN (event_id % 300)::DOUBLE END AS seconds FROM events
"""
)
def parse_duration(t: Tables) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(e % 7, F.lit("m"), e % 50, F.lit("s"))).when(e % 4 == 1, F.concat(e % 900, F.lit("ms"))).when(e % 4 == 2, (e % 300).cast("string")).otherwise("Wed, 21 Oct")
    return t.events.select("event_id", X.parse_duration(raw).alias("seconds"))


@query(
    r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) || '   tail. | |' AS shown FROM conversations
"""
)
def strip_citations(t: Tables) -> DataFrame:
    raw = F.concat("text", F.lit(" [1], ([2][3]) tail [12]. |  [4]  |"))
    return t.conversations.select("conv_id", "turn", X.strip_citations(raw).alias("shown"))


@query(
    r"""
WITH s AS (SELECT *, trim(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS x FROM conversations)
SELECT conv_id, turn, '**Kısa cevap:** son ' || turn || chr(10) || chr(10) || x AS shown FROM s
"""
)
def short_answer_first(t: Tables) -> DataFrame:
    first = F.when(F.col("turn") % 2 == 0, "**Kısa cevap:** eski\n\n").otherwise("")
    raw = F.concat(first, "text", F.lit("\n\n**Kısa cevap:** son "), "turn")
    return t.conversations.select("conv_id", "turn", X.short_answer_first(raw).alias("shown"))


@query(r"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(length(text) // 4, floor(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE)) END::BIGINT AS n_tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("n_tokens"))


MARKERS = ", ".join(f"'{w}'" for w in X.MARKER_WORDS)


@query(
    rf"""
SELECT lang, marked, count(*) AS n FROM (SELECT lang, regexp_matches(text, '[{X.MARKER_LETTERS}]') OR len(list_intersect(list_transform(regexp_split_to_array(text, '\s+'), lambda w: lower(trim(w, '.,:;?!()'))), [{MARKERS}])) > 0 AS marked FROM documents) GROUP BY ALL
"""
)
def lang_marker(t: Tables) -> DataFrame:
    return t.documents.select("lang", X.lang_marker(F.col("text")).alias("marked")).groupBy("lang", "marked").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 3 ELSE greatest(1, least(5, trunc(value)))::INTEGER END AS rating FROM events")
def clamp_rating(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", X.clamp_rating(raw).alias("rating"))
