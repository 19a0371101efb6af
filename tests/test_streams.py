import datetime as dt
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunking as D
from scriptorium.operators import layout as L
from scriptorium.operators import scope as C
from scriptorium.operators.retrieve import bm25
from scriptorium.plans import ORACLES, QUERIES
from scriptorium.sources.files import put
from scriptorium.sources.snapshots import Buckets, Generations
from scriptorium.streaming import jobs as S
from scriptorium.streaming.ingest import UPLOADS, Corpus

START = dt.datetime(2024, 1, 1)


def arriving(spark, path, files, schema):
    for rows in files:  # one after the other, so that their order is known
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{path}")
    return S.read_folder(spark, f"file://{path}", spark.createDataFrame([], schema).schema)


def by_sessions(events, gap):
    out = {}
    for user, at in sorted(events):
        mine = out.setdefault(user, [])
        if mine and at - mine[-1][1] <= gap:
            mine[-1] = (mine[-1][0], at, mine[-1][2] + 1)
        else:
            mine.append((at, at, 1))
    return sorted((u, *s) for u, ss in out.items() for s in ss)


def test_late_events_join_sessions_and_streams_equal_batches(spark, tmp_path):
    rng = random.Random(3)
    events = [(u, START + dt.timedelta(minutes=rng.randrange(60 * 24 * 5))) for u in range(8) for _ in range(60)]
    rng.shuffle(events)
    far = (99, START + dt.timedelta(days=40))
    stream = arriving(spark, tmp_path / "in", [events[:150], events[150:300], events[300:], [far]], "user_id long, ts timestamp")
    got = S.run_final(S.sessions(stream, "90 minutes", "10 days"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    want = by_sessions(events, dt.timedelta(minutes=90))
    assert sorted(map(tuple, got.collect())) == want
    batch = S.sessions(spark.createDataFrame(events, "user_id long, ts timestamp"), "90 minutes")
    assert sorted(map(tuple, batch.collect())) == want


def test_totals_of_changed_keys_and_the_latest_of_each(spark, tmp_path):
    stream = arriving(spark, tmp_path / "in", [[(1, 0.1), (2, 0.2)], [(1, 0.2)], [(3, None), (None, 1.0)]], "user_id long, value double")
    got = S.run_latest(S.running_totals(stream), ["user_id"], f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert sorted(((r.user_id, r.runs, None if r.cost is None else float(r.cost)) for r in got.collect()), key=str) == sorted([(1, 2, 0.3), (2, 1, 0.2), (3, 1, None), (None, 1, 1.0)], key=str)
    parts = spark.read.parquet(f"file://{tmp_path}/out").groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in parts) == [(0, 2), (1, 1), (2, 2)]  # a batch writes only what it changes


def test_bad_and_repeated_uploads_stop_nothing(spark, tmp_path):
    schema = "doc_id long, owner_id string, text string, bytes long, page_count long"
    long = "This is a sentence about ships. " * 30
    first = [(1, "a", long, 10, 1), (2, "a", long, 10, 1), (3, "b", long, 10, 1), (4, "a", None, 10, 1), (5, "a", "Big text here.", 10**9, 1), (6, "a", "No page text.", 10, None)]
    second = [(7, "a", long, 10, 1), (8, None, "Nobody owns this text.", 10, 1), (9, "a", "  \n", 10, 1), (10, "a", "Tea and coffee.\n" * 40, 10, 2)]
    stream = arriving(spark, tmp_path / "in", [first, second], schema)
    corpus = Corpus(spark, f"file://{tmp_path}/corpus", lambda docs: docs.select("doc_id", F.lit(1).alias("page_no"), "text"))
    corpus.follow(stream, f"file://{tmp_path}/state").awaitTermination()

    def state():
        uploads = sorted((r.doc_id, r.status, r.error) for r in corpus.table("uploads", UPLOADS).collect())
        pages = sorted(r.doc_id for r in corpus.table("pages", "doc_id long, text string, batch int").collect())
        asked = spark.createDataFrame([(1, "ships"), (2, "coffee"), (3, "nobody")], "query_id long, text string")
        hits = sorted((r.query_id, r.doc_id >> 20) for r in corpus.index.search(asked, 9).collect())
        return uploads, pages, sorted(set(hits)), corpus.index.sums()

    want = [(1, "ready", None), (2, "duplicate", None), (3, "ready", None), (4, "failed", "no text"), (5, "failed", "too large"), (6, "failed", "no pages"), (7, "duplicate", None), (8, "ready", None), (9, "failed", "no text"), (10, "ready", None)]
    once = state()
    assert once[:3] == (want, [1, 3, 8, 10], [(1, 1), (1, 3), (2, 10), (3, 8)])
    corpus.ingest(spark.createDataFrame(second, schema), 1)  # again, as after a failure
    assert state() == once
    corpus.index.close()


@pytest.fixture
def acl(spark):
    docs = [(i, f"u{i % 4}" if i % 9 else None, i % 5 == 0) for i in range(0, 70_000, 700)]
    permitted = spark.createDataFrame(docs, "doc_id long, owner_id string, shared boolean")
    queries = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None), (4, "u3"), (5, "nobody")], "query_id long, user_id string")
    named = spark.createDataFrame([(2, 700), (2, 1400), (2, 3500), (2, 3500), (4, 1), (4, 10_500)], "query_id long, doc_id long")
    scope = {}
    for q, u in [(1, "u1"), (2, "u2"), (3, None), (4, "u3"), (5, "nobody")]:
        names = {2: {700, 1400, 3500}, 4: {1, 10_500}}.get(q)
        scope[q] = {d for d, o, s in docs if (s or (o is not None and o == u)) and (names is None or d in names)}
    return permitted, queries, named, scope


def test_scopes_are_sets(spark, acl):
    permitted, queries, named, scope = acl
    found = C.permitted_scopes(queries, named, permitted)
    hits = [(q, d) for q in scope for d in range(0, 70_000, 350)]
    kept = {(r.query_id, r.doc_id) for r in found.keep(spark.createDataFrame(hits, "query_id long, doc_id long")).collect()}
    assert kept == {(q, d) for q, ds in scope.items() for d in ds}
    assert {r.query_id: (r.n, int(r.key_sum)) for r in found.sizes().collect()} == {q: (len(ds), sum(ds)) for q, ds in scope.items() if ds}


def test_a_search_in_sets_is_a_search_in_pairs(spark, acl):
    permitted, queries, named, scope = acl
    chunks = spark.createDataFrame([(d, f"term{d % 11} term{d % 7} word") for d in range(0, 70_000, 700)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, "term3 term5 word") for q in scope], "query_id long, text string")
    pairs = spark.createDataFrame([(q, d) for q, ds in scope.items() for d in ds], "query_id long, doc_id long")
    rows = lambda s: sorted(map(tuple, bm25(asked, chunks, 5, scope=s).select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(C.Scopes(*(lambda f: (f.members, f.sets))(C.permitted_scopes(queries, named, permitted)))) == rows(pairs)


def test_generations_are_seen_when_they_are_finished(spark, tmp_path):
    store = Generations(spark, f"file://{tmp_path}/g")
    with pytest.raises(FileNotFoundError):
        store.newest()
    store.write(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), 0)
    assert store.newest().columns == ["id", "x"]
    store.write(spark.createDataFrame([(2, "c", 5)], "id long, x string, y long"), 3)
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"file://{tmp_path}/g/generation=4")
    assert store.complete() == [0, 3]
    assert [tuple(r) for r in store.newest().collect()] == [(2, "c", 5)]
    assert sorted(((r.id, r.x, r.y) for r in store.latest("id").collect())) == [(1, "a", None), (2, "c", 5)]


def test_documents_are_replaced_and_other_buckets_stay(spark, tmp_path):
    store = Buckets(spark, f"file://{tmp_path}/b", 4)
    store.write(spark.createDataFrame([(i, f"old{i}") for i in range(12)], "doc_id long, text string"))
    files = lambda: {r.f for r in store.read().where("bucket IN (0, 3)").select(F.concat_ws("@", "_metadata.file_path", "_metadata.file_modification_time").alias("f")).collect()}
    before = files()
    ids, fresh = spark.createDataFrame([(1,), (2,), (6,), (10,), (50,)], "doc_id long"), spark.createDataFrame([(1, "new"), (1, "more"), (7, "not named")], "doc_id long, text string")
    for _ in range(2):
        store.replace(ids, fresh)
        got = sorted((r.doc_id, r.text) for r in store.read().collect())
        assert got == sorted([(i, f"old{i}") for i in range(12) if i not in (1, 2, 6, 10)] + [(1, "new"), (1, "more")])
    assert files() == before


def test_an_arrival_of_many_files_is_one_batch_of_a_stream_that_goes_on(spark, tmp_path):
    rows, seen = spark.range(40).selectExpr("id", "id % 2 AS part"), []
    for k in range(2):
        rows.where(F.col("part") == k).repartition(4).write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.read_folder(spark, f"file://{tmp_path}/in", rows.schema, None)
        stream.writeStream.foreachBatch(lambda df, n: seen.append((n, df.count()))).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, 20), (1, 20)]


def test_ids_below_zero_are_replaced_in_buckets_of_their_own(spark, tmp_path):
    store = Buckets(spark, f"file://{tmp_path}/b", 4)
    store.write(spark.createDataFrame([(i, f"old{i}") for i in range(-8, 8)], "doc_id long, text string"))
    files = lambda: {r.f for r in store.read().where("doc_id >= 0").select("_metadata.file_path").toDF("f").collect()}
    before = files()
    ids = spark.createDataFrame([(i,) for i in range(-8, 0) if i % 4], "doc_id long")
    store.replace(ids, ids.select("doc_id", F.lit("new").alias("text")))
    assert {r.doc_id: r.text for r in store.read().collect()} == {i: "new" if i < 0 and i % 4 else f"old{i}" for i in range(-8, 8)}
    assert files() == before


def test_uploads_with_ids_below_zero_arrive(spark, tmp_path):
    docs = [(-5, "Five fish swim."), (-4, "Four fish swim."), (-2, "Five fish swim."), (1, "One fish swims."), (3, "Three fish swim.")]
    spark.createDataFrame([(i, text, "en", "web", len(text)) for i, text in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["stream_corpus"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.status) for r in rows if r.kind == "upload") == [(-5, "ready"), (-4, "ready"), (-2, "duplicate"), (1, "ready"), (3, "ready")]
    assert {r.doc_id for r in rows if r.kind == "chunk"} == {-5, -4, 1, 3}


SENTENCE = "A plain sentence about ships and harbours that goes on for a while."
LABELS = "ALPHA TANK\nBETA PIPE\nGAMMA PUMP"


def as_sql_has_it(spark, folder, name, docs):
    """A query's rows over documents (doc_id, text) and those of its SQL, sorted."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, text, "en", "web", len(text)) for i, text in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=str), sorted(db.execute(ORACLES[name]).fetchall(), key=str)


def test_all_documents_are_cut_again(spark, tmp_path):
    docs = [(1, SENTENCE), (2, "x\n" + "\n" * 12 + "x"), (3, "\n" * 25), (4, ""), (5, "  "), (6, SENTENCE), (6, SENTENCE), (7, "One text."), (7, "Another text of seven."), (8, LABELS), (8, LABELS), (None, SENTENCE)]
    got, want = as_sql_has_it(spark, tmp_path, "rechunk_idempotent", docs)
    assert got == want and len(got) == len(docs)


def test_short_headings_in_a_row_are_cut_as_the_sql_has_them(spark, tmp_path):
    docs = [(1, f"{LABELS}\n{SENTENCE}"), (40, LABELS + "\n" + "\n".join(f"{SENTENCE} {i}" for i in range(80)))]
    got, want = as_sql_has_it(spark, tmp_path, "rechunk_replaced", docs)
    assert got == want and len(got) == 2


def test_what_arrives_is_told_and_cut_as_the_sql_has_it(spark, tmp_path):
    docs = [(1, f"{LABELS}\n{SENTENCE}"), (2, SENTENCE), (2, SENTENCE), (4, "Some other text."), (4, " \n"), (None, "Nobody has this one.")]
    got, want = as_sql_has_it(spark, tmp_path, "stream_corpus", docs)
    assert got == want and sum(r[0] == "upload" for r in got) == len(docs)


def test_texts_move_once_on_their_way_to_chunks(spark, tmp_path):
    spark.createDataFrame([(i, p, f"Head\n{SENTENCE} {i}\nsayfa {p}") for i in range(9) for p in (1, 2)], "doc_id long, page_no int, text string").write.parquet(f"{tmp_path}/pages")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        node = D.chunk(L.label_runs(L.units(L.strip_edges(spark.read.parquet(f"{tmp_path}/pages")), 1200)))._jdf.queryExecution().sparkPlan()
        node = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, node)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moves = 0
    while True:  # what stands over the texts
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.inputPlan()
        moves += "ShuffleExchange" in node.getClass().getSimpleName()
        if not node.children().size():
            break
        node = node.children().apply(0)
    assert moves == 1


def shuffle_files(spark):
    return {p for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    own = spark.conf.get(key)
    put(spark.range(1000).selectExpr("id", "id % 2 AS part").repartition(3, "id"), f"file://{tmp_path}/a", "part")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(key) == own
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 1000


def test_replaced_rows_are_made_once(spark, tmp_path):
    store, made = Buckets(spark, f"file://{tmp_path}/b", 4), spark.sparkContext.accumulator(0)
    store.write(spark.createDataFrame([(i, f"old{i}") for i in range(12)], "doc_id long, text string"))

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    fresh = spark.createDataFrame([(1, "new"), (5, "new")], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    store.replace(spark.createDataFrame([(1,), (5,), (2,), (6,), (10,)], "doc_id long"), fresh)
    assert made.value == 2
    assert {r.doc_id: r.text for r in store.read().collect()} == {i: "new" if i in (1, 5) else f"old{i}" for i in range(12) if i not in (2, 6, 10)}
