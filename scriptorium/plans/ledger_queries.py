"""Queries of ledgers, answers and audits. Events are traces and steps; customers are users; labels are votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import audit as U
from ..operators import ledger as L
from .registry import Tables, query
from .retrieval_queries import of_items

# ------------------------------------------------------------------ ledgers


@query("SELECT event_id, user_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id WHERE c_acctbal > 0")
def active_sessions(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment", (F.col("c_acctbal") > 0).alias("active"))
    return L.active_sessions(t.events.select("event_id", "user_id"), users).select("event_id", "user_id", "c_mktsegment")


@query(
    """
SELECT c_custkey AS user_id, coalesce(runs, 0) AS runs, coalesce(cost, 0) AS cost, last_at, coalesce(docs, 0) AS docs, coalesce(convs, 0) AS convs FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS runs, round(sum(o_totalprice::DECIMAL(28, 9)), 4)::DOUBLE AS cost, max(o_orderdate) AS last_at FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS docs FROM events GROUP BY 1) e ON e.user_id = c_custkey LEFT JOIN (SELECT conv_id, count(*) AS convs FROM conversations GROUP BY 1) v ON v.conv_id = c_custkey
"""
)
def user_usage(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    traces = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("cost"), F.col("o_orderdate").alias("at"))
    return L.user_usage(users, traces, t.events.select("user_id"), t.conversations.select(F.col("conv_id").alias("user_id")))


@query("SELECT c_nationkey, max(c_custkey) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def empty_parent(t: Tables) -> DataFrame:
    return L.empty_parents(t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), "c_nationkey")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS questions, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0 ORDER BY conv_id DESC LIMIT 60")
def conversation_list(t: Tables) -> DataFrame:
    return L.conversation_list(t.conversations)


def _traces(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", (F.col("value") / 1000).alias("cost"), F.col("value").alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))


# Sums and means of decimals: a mean is rounded half up in whole numbers of billionths.
def mean_sql(amount: str) -> str:
    units, n = f"sum(round({amount} * 1000000000)::HUGEINT)", "count(*)"
    return f"coalesce(((2 * {units} + 1000 * {n}) // (2000 * {n}))::DOUBLE / 1000000, 0)"


SUMMARY = f"count(*) AS runs, coalesce(round(sum((value / 1000)::DECIMAL(28, 9)), 4)::DOUBLE, 0) AS cost, {mean_sql('value / 1000')} AS mean_cost, {mean_sql('value')} AS mean_ms"


@query(f"SELECT user_id, {SUMMARY} FROM events GROUP BY 1 UNION ALL SELECT NULL, {SUMMARY} FROM events")
def trace_summary(t: Tables) -> DataFrame:
    return L.trace_summary(_traces(t), "user_id").unionByName(L.trace_summary(_traces(t)).withColumn("user_id", F.lit(None).cast("long")))


@query("SELECT 'event_type' AS by, event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'tier', CAST(json_extract_string(props, '$.k') AS BIGINT) % 3, count(*) FROM events GROUP BY ALL")
def trace_by_route(t: Tables) -> DataFrame:
    return L.trace_by(_traces(t).withColumn("tier", F.col("k") % 3), "event_type", "tier")


@query("SELECT count(*) AS votes, count(*) FILTER (toxic = 0) AS up, count(*) FILTER (toxic = 1) AS down, count(*) FILTER (quality = 0) AS corrected FROM labels")
def feedback_stats(t: Tables) -> DataFrame:
    return L.feedback_stats(t.labels.select(F.when(F.col("toxic") == 1, -1).otherwise(1).alias("vote"), (F.col("quality") == 0).alias("corrected")))


@query("SELECT count(*) AS messages, count(DISTINCT conv_id) AS chats, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'system') AS system FROM conversations")
def entity_counts(t: Tables) -> DataFrame:
    return t.conversations.agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conv_id").alias("chats"), F.count_if(F.col("role") == "user").alias("questions"), F.count_if(F.col("role") == "system").alias("system"))


def _steps(t: Tables) -> DataFrame:
    """Ten events in a row are the steps of a run."""
    e = _traces(t)
    error = F.when(F.col("event_type") == "error", "failed")
    return e.select(F.floor(F.col("event_id") / 10).alias("run_id"), (F.col("event_id") % 10).alias("step"), F.col("event_type").alias("node"), "ms", "cost", F.col("k").alias("tokens"), error.alias("error"))


@query("SELECT event_type AS node, count(*) AS calls, round(sum((value / 1000)::DECIMAL(28, 9)), 4)::DOUBLE AS cost, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens, round(median(value), 6) AS median_ms, max(value) AS max_ms, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def node_profile(t: Tables) -> DataFrame:
    return L.node_profile(_steps(t))


@query("SELECT event_id // 10 AS run_id, event_id % 10 AS step, greatest(2, round(CASE WHEN sum(value) OVER w > 0 THEN 100 * value / sum(value) OVER w ELSE 0 END, 6)) AS share FROM events WINDOW w AS (PARTITION BY event_id // 10)")
def step_share(t: Tables) -> DataFrame:
    return L.step_share(_steps(t)).select("run_id", "step", "share")


@query(
    """
WITH p AS (SELECT * FROM (VALUES ('A', 3.0::DOUBLE, 15.0::DOUBLE), ('N', 0.25::DOUBLE, 1.25::DOUBLE), ('R', 1.0::DOUBLE, 5.0::DOUBLE)) v(tier, price_in, price_out))
SELECT l_orderkey AS run_id, round(sum(((l_quantity * 100 * price_in + l_linenumber * 50 * price_out) / 1000000.0::DOUBLE)::DECIMAL(28, 9)), 8)::DOUBLE AS cost, count(*) AS calls FROM lineitem JOIN p ON tier = l_returnflag GROUP BY 1
"""
)
def run_cost(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame([("A", 3.0, 15.0), ("N", 0.25, 1.25), ("R", 1.0, 5.0)], "tier string, price_in double, price_out double")
    calls = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("tier"), (F.col("l_quantity") * 100).alias("tokens_in"), (F.col("l_linenumber") * 50).alias("tokens_out"))
    return L.run_cost(calls, prices)


@query(
    """
WITH s AS (SELECT event_id // 10 AS run_id, event_id % 10 AS step, round(sum(value / 1000) OVER w, 9) AS spent, round(sum(value) OVER w / 1000, 9) AS took FROM events WINDOW w AS (PARTITION BY event_id // 10 ORDER BY event_id))
SELECT run_id, arg_min(step, step) AS step, arg_min(CASE WHEN spent >= 0.3 THEN 'cost' ELSE 'time' END, step) AS reason FROM s WHERE spent >= 0.3 OR took >= 0.25 GROUP BY 1
"""
)
def budget_breach(t: Tables) -> DataFrame:
    return L.budget_breach(_steps(t), cost=0.3, seconds=0.25)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 3")
def nth_message(t: Tables) -> DataFrame:
    return L.nth_message(t.conversations, 2).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE turn < 2 OR conv_id % 3 <> 0 UNION ALL SELECT DISTINCT conv_id, 2, 'user', 'again ' || conv_id FROM conversations WHERE conv_id % 3 = 0")
def replace_after(t: Tables) -> DataFrame:
    edits = t.conversations.where("conv_id % 3 = 0").select("conv_id").distinct().select("conv_id", F.lit(2).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("again "), "conv_id").alias("text"))
    return L.replace_after(t.conversations.select("conv_id", "turn", "role", "text"), edits)


@query("SELECT conv_id, turn, role, back FROM (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations c JOIN (SELECT conv_id, max(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id) WHERE turn < asked) WHERE back <= 4")
def history_tail(t: Tables) -> DataFrame:
    return L.history_tail(t.conversations).select("conv_id", "turn", "role", "back")


@query(
    """
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, k
"""
)
def session_activity(t: Tables) -> DataFrame:
    return L.session_activity(t.events, "6 hours")


GONE = "gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))"


@query(f"WITH {GONE} SELECT 'customer' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM o) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)")
def cascade_delete(t: Tables) -> DataFrame:
    tables = {
        "customer": (t.customer.withColumn("child", F.col("c_custkey")), "c_custkey"),
        "orders": (t.orders.withColumn("child", F.col("o_orderkey")), "o_custkey"),
        "lineitem": (t.lineitem, "l_orderkey"),
    }
    left, out = L.cascade_delete(tables, t.customer.where("c_acctbal < 0").select("c_custkey")), None
    for name, df in left.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, coalesce(quality::BIGINT, 9999) AS owner_id, CASE WHEN quality IS NULL THEN 'ortak' ELSE 'ozel' END AS visibility FROM documents LEFT JOIN labels USING (doc_id)")
def backfill_owner(t: Tables) -> DataFrame:
    docs = t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.col("quality").cast("long").alias("owner_id"), F.lit("ozel").alias("visibility"))
    return L.backfill_owner(docs, F.lit(9999).cast("long")).select("doc_id", "owner_id", "visibility")


@query("SELECT 'owner' AS kind, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500) UNION ALL SELECT 'admin', c_nationkey FROM customer WHERE c_acctbal > -500 GROUP BY c_nationkey HAVING count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 8000) = 0")
def constraint_violations(t: Tables) -> DataFrame:
    users = t.customer.where("c_acctbal > -500").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"), (F.col("c_acctbal") > 8000).alias("active"))
    return L.constraint_violations(users, t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner_id")))


# ------------------------------------------------------------------ answers


def _hits(t: Tables) -> DataFrame:
    """Turns stand for hits: conversations in tens are queries, every turn belongs to the document of its conversation."""
    c = t.conversations
    rank = F.col("turn") * 1000 + (F.col("conv_id") * 7) % 1000
    kind = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "summary").otherwise("body")
    return c.select(
        (F.floor(F.col("conv_id") / 10)).alias("query_id"), rank.alias("rank"), F.col("conv_id").alias("doc_id"), F.concat(F.lit("chat "), "conv_id").alias("title"), kind.alias("kind"),
        (F.col("turn") + 1).cast("int").alias("page_start"), (F.col("turn") + 1 + F.col("turn") % 2).cast("int").alias("page_end"), F.col("turn").alias("ordinal"), F.col("role").alias("section"), "text", (1 / (F.col("turn") + 2)).alias("score"),
    )


HITS = """
h AS (SELECT conv_id // 10 AS query_id, turn * 1000 + (conv_id * 7) % 1000 AS rank, conv_id AS doc_id, turn, role, text, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'summary' ELSE 'body' END AS kind, turn + 1 AS a, turn + 1 + turn % 2 AS b FROM conversations),
n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id) AS n FROM h GROUP BY query_id, doc_id),
p AS (SELECT h.*, n, role || ' · ' || CASE WHEN kind = 'summary' THEN 'özet' WHEN a = b THEN 's. ' || a ELSE 's. ' || a || '-' || b END AS place FROM h JOIN n USING (query_id, doc_id))
"""
HITS = HITS.replace("n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id) AS n FROM h GROUP BY query_id, doc_id)", "n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY m, doc_id) AS n FROM (SELECT query_id, doc_id, min(rank) AS m FROM h GROUP BY ALL))")


@query(f"WITH {HITS} SELECT query_id, doc_id, turn, place FROM p")
def hit_location(t: Tables) -> DataFrame:
    from ..functions import text as X

    place = X.page_label(F.col("section"), F.col("kind"), F.col("page_start"), F.col("page_end"))
    return _hits(t).select("query_id", "doc_id", F.col("ordinal").alias("turn"), place.alias("place"))


@query(f"WITH {HITS} SELECT query_id, n::INTEGER AS n, doc_id, round(max(1 / (turn + 2)::DOUBLE), 3) AS score, count(*)::INTEGER AS passages, string_agg(place, '; ' ORDER BY kind <> 'summary', a, turn) AS places, count(*) FILTER (length(text) > 200)::INTEGER AS cut FROM p GROUP BY query_id, n, doc_id")
def citations(t: Tables) -> DataFrame:
    cited = A.citations(_hits(t), snippet=200)
    places = F.array_join(F.transform("passages", lambda p: p["place"]), "; ")
    return cited.select("query_id", "n", "doc_id", "score", F.size("passages").alias("passages"), places.alias("places"), F.size(F.filter("passages", lambda p: p["truncated"])).alias("cut"))


@query(
    f"""
WITH {HITS}, b AS (SELECT query_id, n, '[' || n || '] chat ' || doc_id || chr(10) || string_agg('  — ' || place || chr(10) || '  ' || text, chr(10) ORDER BY kind <> 'summary', a, turn) AS block FROM p GROUP BY query_id, n, doc_id)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS context FROM b GROUP BY 1
"""
)
def context_text(t: Tables) -> DataFrame:
    return A.context_text(_hits(t))


@query(f"WITH {HITS} SELECT query_id, n::INTEGER AS n, string_agg(DISTINCT a::VARCHAR, ',' ORDER BY a::VARCHAR) AS pages, count(*)::INTEGER AS passages FROM p GROUP BY query_id, n")
def citation_pages(t: Tables) -> DataFrame:
    return A.citation_pages(A.citations(_hits(t)))


@query(
    """
WITH r AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'writer' WHEN 1 THEN 'strong' END AS forced, CASE WHEN doc_id % 5 = 0 THEN 'capraz' ELSE 'belge_ici' END AS category, (doc_id % 5 + 1) AS difficulty, n_chars AS tokens FROM documents)
SELECT doc_id, CASE WHEN forced = 'writer' AND category = 'capraz' THEN 'strong' WHEN forced IS NOT NULL THEN forced WHEN category = 'capraz' OR difficulty >= 4 OR tokens > 2500 THEN 'strong' ELSE 'writer' END AS tier,
  CASE WHEN forced = 'writer' AND category = 'capraz' THEN 'floor' WHEN forced IS NOT NULL THEN 'forced' ELSE concat_ws(', ', CASE WHEN category = 'capraz' THEN 'category=capraz' END, CASE WHEN difficulty >= 4 THEN 'difficulty=' || difficulty END, CASE WHEN tokens > 2500 THEN 'context=' || tokens END) END AS reasons FROM r
"""
)
def route_tier(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    runs = t.documents.select("doc_id", F.when(d % 7 == 0, "writer").when(d % 7 == 1, "strong").alias("forced"), F.when(d % 5 == 0, "capraz").otherwise("belge_ici").alias("category"), (d % 5 + 1).alias("difficulty"), F.col("n_chars").alias("tokens"))
    return A.route_tier(runs).select("doc_id", "tier", "reasons")


@query(
    """
WITH d AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id, lang FROM documents), f AS (SELECT query_id, doc_id FROM d WHERE doc_id % 9 = 0 AND query_id % 3 > 0 AND doc_id % 13 <> 0), n AS (SELECT query_id, doc_id FROM d WHERE lang = 'fr'),
g AS (SELECT query_id, count(*) AS k, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM f GROUP BY 1), m AS (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM n GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN k = 1 THEN 'belge_ici' ELSE 'capraz' END AS category, coalesce(g.ids, m.ids, '') AS doc_ids FROM benchmark LEFT JOIN g ON g.query_id = item_id LEFT JOIN m ON m.query_id = item_id
"""
)
def apply_focus(t: Tables) -> DataFrame:
    docs = of_items(t, "lang")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit("capraz").alias("category"))
    focus = docs.where("doc_id % 9 = 0 AND query_id % 3 > 0").select("query_id", "doc_id")
    return A.apply_focus(asked, docs.where("lang = 'fr'").select("query_id", "doc_id"), focus, docs.where("doc_id % 13 <> 0").select("doc_id"))


@query(
    r"""
WITH r AS (SELECT doc_id, text AS summary FROM documents WHERE doc_id % 13 <> 0), n AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON doc_id % (SELECT count(*) FROM benchmark) = item_id WHERE item_id % 4 > 0)
SELECT query_id, doc_id, summary AS shown FROM n JOIN r USING (doc_id) UNION ALL
SELECT NULL, doc_id, substr(string_split(trim(regexp_replace(regexp_replace(summary, '^\s+', ''), '\s+$', '')), chr(10) || chr(10))[1], 1, 320) FROM r
"""
)
def summary_listing(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("text").alias("summary"), F.when(F.col("doc_id") % 13 == 0, "deleted").otherwise("ready").alias("status"))
    asked = t.benchmark.where("item_id % 4 > 0").select(F.col("item_id").alias("query_id"))
    return A.summary_listing(of_items(t).join(asked, "query_id"), docs)


@query("SELECT doc_id AS run_id, CASE WHEN quality = 0 OR toxic = 1 OR n_chars > 5000 OR doc_id % 6 < 2 THEN 'low' ELSE 'normal' END AS confidence FROM documents LEFT JOIN labels USING (doc_id)")
def confidence(t: Tables) -> DataFrame:
    runs = t.documents.select(F.col("doc_id").alias("run_id"), (F.col("n_chars") > 5000).alias("breached"), (F.col("doc_id") % 6).alias("hits"))
    return A.confidence(runs, t.labels.select(F.col("doc_id").alias("run_id"), (F.col("toxic") == 0).alias("grounded"), (F.col("quality") == 1).alias("sufficient")))


# ------------------------------------------------------------------ audits


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE WHEN 1 THEN CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE ELSE CAST(l_quantity AS BIGINT) * 1000 END::DOUBLE AS value FROM lineitem")
def tr_number(t: Tables) -> DataFrame:
    english = F.format_number("l_extendedprice", 2)
    turkish = F.translate(english, ",.", ".,")
    raw = F.when(F.col("l_linenumber") % 3 == 0, english).when(F.col("l_linenumber") % 3 == 1, turkish).otherwise(F.concat(F.col("l_quantity").cast("long"), F.lit(".000.")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", U.tr_number(raw).cast("double").alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, regexp_replace(replace(replace(replace(format('{:,}', c // 100), ',', '_'), '.', ','), '_', '.') || ',' || lpad((c % 100)::VARCHAR, 2, '0'), ',?0*$', '') AS shown FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)")
def tr_format(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", U.tr_format(F.col("l_extendedprice").cast("decimal(18,2)")).alias("shown"))


def _answers(t: Tables) -> DataFrame:
    """An answer an event: value × k = product (wrong for some) = sum + 1, with a short answer that states it or not."""
    e = t.events.select("event_id", F.floor(F.col("value")).cast("long").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    p = F.col("v") * F.col("k") + F.when(F.col("event_id") % 5 == 0, 7).otherwise(0)
    said = F.when(F.col("event_id") % 3 == 0, p.cast("string")).otherwise("yok")
    line = F.concat(F.lit("- **Hesap:** "), "v", F.lit(" × "), "k", F.lit(" = "), p, F.lit(" = "), p - 1, F.lit(" + 1 → sonuç"))
    extra = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("\nHesap: 2 + 3 × 4 − 6 / 3 = 12\nhesap: % 50 × "), "k", F.lit(" x = bilinmez\nHesap: "), "k", F.lit(" = "), "k", F.lit("\nHesap: ("), "v", F.lit(" + 3 TL) × 2 − ("), "k", F.lit(" − (1 + 1)) = "), (F.col("v") + 3) * 2 - (F.col("k") - 2))).otherwise("")
    return e.select(F.col("event_id").alias("run_id"), "v", "k", F.concat(F.lit("**Kısa cevap:** "), said, F.lit("\n\n"), line, extra).alias("answer"))


BASE = "e AS (SELECT event_id AS run_id, floor(value)::BIGINT AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 5 = 0 THEN 7 ELSE 0 END AS off FROM events)"


@query(f"WITH {BASE} SELECT run_id, 0 AS pos, v || ' × ' || k || ' = ' || (v * k + off) || ' = ' || (v * k + off - 1) || ' + 1 → sonuç' AS line, 3 AS parts FROM e UNION ALL SELECT run_id, u.pos, CASE u.pos WHEN 1 THEN '2 + 3 × 4 − 6 / 3 = 12' WHEN 2 THEN '% 50 × ' || k || ' x = bilinmez' WHEN 3 THEN k || ' = ' || k ELSE '(' || v || ' + 3 TL) × 2 − (' || k || ' − (1 + 1)) = ' || ((v + 3) * 2 - (k - 2)) END, 2 FROM e CROSS JOIN (VALUES (1), (2), (3), (4)) u(pos) WHERE run_id % 4 = 0")
def calc_lines(t: Tables) -> DataFrame:
    return U.calc_lines(_answers(t)).select("run_id", "pos", "line", F.size("parts").alias("parts"))


AUDIT = f"""
{BASE}, a AS (SELECT run_id, 0 AS pos, 0 AS link, (v * k)::DOUBLE AS expected, (v * k + off)::DOUBLE AS written, off <= 1 AS ok FROM e
UNION ALL SELECT run_id, 0, 1, (v * k)::DOUBLE, (v * k + off)::DOUBLE, off <= 1 FROM e UNION ALL SELECT run_id, 1, 0, 12, 12, TRUE FROM e WHERE run_id % 4 = 0
UNION ALL SELECT run_id, 4, 0, ((v + 3) * 2 - (k - 2))::DOUBLE, ((v + 3) * 2 - (k - 2))::DOUBLE, TRUE FROM e WHERE run_id % 4 = 0)
"""


def _audit(t: Tables) -> DataFrame:
    return U.calc_audit(U.calc_lines(_answers(t)))


@query(f"WITH {AUDIT} SELECT * FROM a")
def calc_audit(t: Tables) -> DataFrame:
    return _audit(t).select("run_id", "pos", "link", F.col("expected").cast("double").alias("expected"), F.col("written").cast("double").alias("written"), "ok")


@query(f"WITH {AUDIT} SELECT run_id, count(*) AS checked, count(*) FILTER (NOT ok) AS wrong FROM a GROUP BY 1")
def calc_report(t: Tables) -> DataFrame:
    return U.calc_report(_audit(t))


@query(f"WITH {AUDIT} SELECT DISTINCT run_id, run_id % 3 <> 0 AS missing FROM a")
def calc_missing(t: Tables) -> DataFrame:
    return U.calc_missing(_answers(t), _audit(t))


PAIRS = r"p AS (SELECT a.conv_id, a.turn, trim(regexp_replace(strip_accents(a.text), '[^a-zA-Z ]+', ' ', 'g')) AS truth, trim(regexp_replace(strip_accents(b.text), '[^a-zA-Z ]+', ' ', 'g')) AS read FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(t: Tables) -> DataFrame:
    """Neighbouring turns as a text and its reading, in plain letters since DuckDB's distance counts bytes."""
    plain = F.trim(F.regexp_replace(F.translate("text", "áàâäãéèêëíìîïóòôöúùûüñçÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ", "aaaaaeeeeiiiioooouuuuncAAAAEEEEIIIIOOOOUUUUNC"), "[^a-zA-Z ]+", " "))
    c = t.conversations.select("conv_id", "turn", plain.alias("x"))
    return c.withColumnRenamed("x", "truth").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("read")), ["conv_id", "turn"])


@query(rf"WITH {PAIRS}, f AS (SELECT conv_id, turn, trim(regexp_replace(truth, '\s+', ' ', 'g')) AS a, trim(regexp_replace(read, '\s+', ' ', 'g')) AS b FROM p) SELECT conv_id, turn, round(levenshtein(a, b)::DOUBLE / greatest(1, length(a)), 6) AS cer FROM f")
def cer(t: Tables) -> DataFrame:
    return _pairs(t).select("conv_id", "turn", F.round(U.char_error("truth", "read"), 6).alias("cer"))


@query()
def wer(t: Tables) -> DataFrame:
    return _pairs(t).select("conv_id", "turn", F.round(U.word_error("truth", "read"), 6).alias("wer"))


@query("SELECT doc_id, CASE WHEN n > 0 THEN round(g::DOUBLE / n, 9) ELSE 0 END AS loss FROM (SELECT doc_id, len(regexp_extract_all(text, '[çğıöşüÇĞİÖŞÜ]')) AS n, len(regexp_extract_all(text, '[üçÜ]')) AS g FROM documents)")
def diacritic_loss(t: Tables) -> DataFrame:
    read = t.documents.withColumn("read", F.translate("text", "üçÜ", "ucU"))
    return read.select("doc_id", F.round(U.diacritic_loss("text", "read"), 9).alias("loss"))


@query(
    rf"""
WITH {PAIRS}, f AS (SELECT conv_id, turn, trim(regexp_replace(truth, '\s+', ' ', 'g')) AS a, trim(regexp_replace(read, '\s+', ' ', 'g')) AS b FROM p), r AS (SELECT conv_id % 3 AS kind, turn % 2 AS variant, levenshtein(a, b)::DOUBLE / greatest(1, length(a)) AS cer, length(a) / 100.0::DOUBLE AS seconds FROM f)
SELECT kind, variant, count(*) AS pages, round(avg(cer), 6) AS cer, 0.0::DOUBLE AS loss, round(median(seconds), 6) AS median_seconds, max(seconds) AS max_seconds FROM r GROUP BY ALL
"""
)
def ocr_report(t: Tables) -> DataFrame:
    rates = _pairs(t).select((F.col("conv_id") % 3).alias("kind"), (F.col("turn") % 2).alias("variant"), U.char_error("truth", "read").alias("cer"), U.diacritic_loss("truth", "read").alias("loss"), (F.length(F.regexp_replace("truth", r"\s+", " ")) / 100).alias("seconds"))
    return U.ocr_report(rates)


def _checks(t: Tables) -> tuple[DataFrame, DataFrame]:
    answers = t.orders.select(F.col("o_orderkey").alias("no"), F.concat(F.lit("Total "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" for "), "o_orderpriority").alias("answer"))
    kinds = t.orders.select(F.col("o_orderkey").alias("no"), F.floor("o_totalprice").cast("string").alias("whole"), F.explode(F.array(*map(F.lit, ["number", "any", "none", "forbidden", "context"]))).alias("kind"))
    values = F.when(F.col("kind") == "number", F.array("whole")).when(F.col("kind") == "context", F.array(F.lit("total"), F.lit("low"), F.lit("high"))).otherwise(F.array(F.lit("URGENT"), F.lit("MEDIUM")))
    return answers, kinds.select("no", "kind", values.alias("values"), F.lit(r"\b[45]-").alias("pattern"))


CHECKS = "c AS (SELECT o_orderkey AS no, k.kind, CASE k.kind WHEN 'number' THEN TRUE WHEN 'any' THEN regexp_matches(o_orderpriority, 'URGENT|MEDIUM') WHEN 'none' THEN NOT regexp_matches(o_orderpriority, 'URGENT|MEDIUM') WHEN 'forbidden' THEN NOT regexp_matches(o_orderpriority, '^[45]-') ELSE regexp_matches(lower(o_orderpriority), 'low|high') END AS passed FROM orders CROSS JOIN (VALUES ('number'), ('any'), ('none'), ('forbidden'), ('context')) k(kind))"


@query(f"WITH {CHECKS} SELECT no, kind, passed FROM c")
def answer_checks(t: Tables) -> DataFrame:
    return U.answer_checks(*_checks(t))


@query(f"WITH {CHECKS} SELECT count(*) AS questions, count(*) FILTER (good) AS passed FROM (SELECT no, bool_and(passed) AS good FROM c GROUP BY 1)")
def eval_report(t: Tables) -> DataFrame:
    return U.eval_report(U.answer_checks(*_checks(t)))
