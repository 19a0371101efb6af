import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunking as D
from scriptorium.operators import retrieve as R
from scriptorium.operators import vectors as V
from scriptorium.sources import index as I
from scriptorium.streaming import jobs as S

CHUNK = "row_id long, doc_id long, kind string, text string, embedding array<float>"


def brute(queries, rows, k):
    out = []
    for q, x in queries:
        best = {}
        for key, y in rows:
            if y is not None and len(y) == len(x):
                score = round(float(np.dot(np.array(x, np.float64), np.array(y, np.float64))), 6)
                best[key] = max(best.get(key, -9.0), score)
        out += [(q, r + 1, key, score) for r, (score, key) in enumerate(sorted(((s, key) for key, s in best.items()), key=lambda p: (-p[0], p[1]))[:k])]
    return out


def unit(rng, n):
    x = rng.normal(size=n)
    return (x / np.linalg.norm(x)).astype(np.float32).tolist()


def test_nearest_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 17)
    rng = np.random.default_rng(3)
    rows = [(i, unit(rng, 6)) for i in range(300)] + [(400 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(500, None), (501, [1.0])]
    queries = [(i, unit(rng, 6)) for i in range(20)] + [(99, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df, asked = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in R.cosine(asked, df, 7).collect())
    assert got == sorted(brute(queries, rows, 7))
    monkeypatch.setattr(V, "QUERY_BYTES", 200)  # several blocks of queries
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in R.cosine(asked, df, 7).collect()) == got
    groups = [(key % 12, y) for key, y in rows]
    found = V.nearest(asked, spark.createDataFrame(groups, "doc long, embedding array<float>").repartition(3), 4, "doc").groupBy("query_id", "doc").agg(F.max("score").alias("score"))
    assert sorted((r.query_id, r["rank"], r.doc, r.score) for r in R.top(found, 4, F.desc("score"), F.col("doc")).collect()) == sorted(brute(queries, groups, 4))
    assert R.cosine(asked.limit(0), df, 3).count() == 0 and R.cosine(asked, df.limit(0), 3).count() == 0


def test_scores_are_held_in_tiles():
    """A block of queries against a slice of rows is never held whole: it would be 330 MB here."""
    rng = np.random.default_rng(4)
    shared = SimpleNamespace(value=(np.arange(20_000), rng.normal(size=(20_000, 2))))
    vectors = pa.array(rng.normal(size=(2048, 2)).tolist(), pa.list_(pa.float64()))
    tracemalloc.start()
    found = sum(b.num_rows for b in V._ask(shared, 3, pa.int64())(iter([pa.RecordBatch.from_arrays([pa.array(range(2048)), vectors], names=["key", "embedding"])])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 60_000 and most < 120 << 20


def test_equal_scores_are_held_in_tiles():
    """Of a tile's equal scores only the smallest keys go on; all of a tile of 2^20 and their order would be about 95 MB."""
    shared = SimpleNamespace(value=(np.arange(3000), np.random.default_rng(5).normal(size=(3000, 2))))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4095, -1, -1)), pa.array([[1.0, 1.0]] * 4096, pa.list_(pa.float64()))], names=["key", "embedding"])
    tracemalloc.start()
    found = pa.Table.from_batches(V._ask(shared, 20, pa.int64())(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["key"].to_pylist() == [*range(20)] * 3000 and most < 40 << 20


def test_a_product_that_is_no_number_displaces_none():
    """Where a row's product is NaN the row takes no part; the k best others stay."""
    shared = SimpleNamespace(value=(np.array([1]), np.array([[1.0, 0.0]])))
    rows = [[float("nan") if i == 7 else float(i), 0.0] for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(rows, pa.list_(pa.float64()))], names=["key", "embedding"])
    assert pa.Table.from_batches(V._ask(shared, 3, pa.int64())(iter([batch])))["key"].to_pylist() == [49, 48, 47]
    batch = pa.RecordBatch.from_arrays([pa.array([i // 2 for i in range(50)]), pa.array(rows, pa.list_(pa.float64()))], names=["key", "embedding"])
    assert pa.Table.from_batches(V._ask(shared, 23, pa.int64())(iter([batch]))).slice(20)["key"].to_pylist() == [4, 3, 2]  # 6 and 7 share a key, which 6 speaks for


def test_rounded_ties_go_to_smaller_keys():
    """Products that are one number only once they are rounded, in many slices and tiles."""
    rng = np.random.default_rng(6)
    queries, rows = rng.normal(size=(40, 3)) * 1e-3, rng.normal(size=(9000, 3)) * 1e-3
    keys = rng.permutation(9000)
    shared = SimpleNamespace(value=(np.arange(40), queries))
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["key", "embedding"])
    found = pa.Table.from_batches(V._ask(shared, 8, pa.int64())(iter([batch])))
    scores = np.round(queries @ rows.T, 6)
    assert found["key"].to_pylist() == [int(keys[j]) for q in range(40) for j in np.lexsort((keys, -scores[q]))[:8]]


def test_block_holds_what_a_task_keeps_for_it(spark, monkeypatch):
    """Short vectors and many hits a query: a task's table of hits counts, not only the vectors."""
    monkeypatch.setattr(V, "QUERY_BYTES", 64_000)
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(400)], "query_id long, embedding array<double>")
    sizes = [t.num_rows for t, _ in V._blocks(asked, kept=16 * 100)]
    assert sum(sizes) == 400 and max(sizes) * (16 + 16 * 100) < 2 * 64_000
    assert [t.num_rows for t, _ in V._blocks(asked)] == [400]


def test_terms_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(R, "TERMS", 10)
    texts = [[f"t{(i * j) % 7}" for j in range(i % 9)] for i in range(40)] + [["x"] * 50, None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], names=["key", "ts"])
    parts = list(R._count(True)(iter([batch])))
    got = sorted(((r["key"], r["length"], r["token"] or "", r["tf"]) for p in parts for r in p.to_pylist()))
    assert got == sorted((i, len(ts or []), t, (ts or []).count(t)) for i, ts in enumerate(texts) for t in set(ts or [""]))
    assert len(parts) > 10 and all(sum(r["tf"] for r in p.to_pylist()) <= 10 for p in parts if p.to_pylist()[0]["token"] != "x")


def test_per_document_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 17)
    monkeypatch.setattr(V, "TILE", 20)
    rng = np.random.default_rng(8)
    rows = [(i, f"d{i % 12}", unit(rng, 6)) for i in range(200)]
    rows += rows[:30] + [(300, "d1", None), (301, None, unit(rng, 6))]
    queries = [(i, unit(rng, 6)) for i in range(20)]
    chunks, asked = spark.createDataFrame(rows, "row_id long, doc string, embedding array<float>").repartition(5), spark.createDataFrame(queries, "query_id long, embedding array<float>")
    want = []
    for q, x in queries:
        score = {}
        for key, doc, y in rows:
            if doc and y:
                score.setdefault(doc, []).append((-round(float(np.dot(np.array(x, float), np.array(y, float))), 6), key))
        for doc in sorted(score, key=lambda d: (min(score[d])[0], d))[:4]:
            want += [(q, doc, key, -s, rank) for rank, (s, key) in enumerate(sorted(score[doc])[:3], 1)]
    found = R.per_document(asked, chunks, "row_id", "doc", 3, 4)
    assert sorted((r.query_id, r.doc, r.row_id, r.score, r["rank"]) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "zip_with" not in plan  # no row is made for a query and a chunk


def test_hybrid_search(spark):
    rng = random.Random(5)
    words = [f"kelime{i}" for i in range(30)]
    g = np.random.default_rng(6)
    rows = [(i, i % 9, "summary" if i % 10 == 0 else "body", " ".join(rng.choice(words) for _ in range(12)), unit(g, 4) if i % 7 else None) for i in range(120)]
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = spark.createDataFrame([(1, "kelime3 kelime4", unit(g, 4)), (2, "hiç yok", unit(g, 4)), (3, "kelime5", None)], "query_id long, text string, embedding array<float>")
    got = R.hybrid_search(asked, chunks, top_k=6, cap=2).collect()
    dense = {(r.query_id, r.row_id): (r["rank"], r.score) for r in R.cosine(asked, chunks, 24, key="row_id").collect()}
    sparse = {(r.query_id, r.row_id): r["rank"] for r in R.bm25(asked, chunks, 24, key="row_id").collect()}
    by_row = {r[0]: r for r in rows}
    for q in (1, 2, 3):
        keys = {k for k in (*dense, *sparse) if k[0] == q}
        fused = {k: round((1 / (60 + dense[k][0]) if k in dense else 0) + (1 / (60 + sparse[k]) if k in sparse else 0), 9) for k in keys}
        order = sorted(keys, key=lambda k: (-fused[k], dense.get(k, (999,))[0], sparse.get(k, 999), k[1]))
        kept, seen = [], {}
        for k in order:
            doc = by_row[k[1]][1]
            if seen.get(doc, 0) < 2:
                seen[doc] = seen.get(doc, 0) + 1
                kept.append(k[1])
        mine = sorted((r["rank"], r.row_id) for r in got if r.query_id == q)
        assert [row for _, row in mine] == kept[:6]
    vectors = {1: asked.collect()[0].embedding, 2: asked.collect()[1].embedding}
    for r in got:
        y = by_row[r.row_id][4]
        want = None if r.query_id == 3 or y is None else round(float(np.dot(np.array(vectors[r.query_id], float), np.array(y, float))), 6)
        assert r.dense_score == want  # also for hits that only their words have found
    assert any(r.rank_dense is None and r.dense_score is not None for r in R.hybrid_search(asked, chunks, top_k=40, cap=0, width=5, mode="bm25").collect())
    only = R.hybrid_search(asked, chunks, top_k=6, mode="dense", kinds=("summary",)).collect()
    assert only and all(by_row[r.row_id][2] == "summary" and r.rank_sparse is None for r in only)
    scope = spark.createDataFrame([(1, 5), (1, 6), (2, 8)], "query_id long, row_id long")
    assert {(r.query_id, r.row_id) for r in R.hybrid_search(asked, chunks, scope=scope, cap=0).collect()} <= {(1, 5), (1, 6), (2, 8)}
    with pytest.raises(ValueError):
        R.hybrid_search(asked, chunks, mode="other")
    assert {r.query_id: r.rescued for r in R.rescue(spark.createDataFrame([(1, 0.5), (1, 0.1), (2, 0.49), (3, None)], "query_id long, dense_score double")).collect()} == {1: True, 2: False, 3: False}


def test_lists_and_scope(spark):
    docs = spark.createDataFrame([(i, i % 3, "ortak" if i % 4 == 0 else "ozel", "deleted" if i == 8 else "ready") for i in range(12)], "doc_id long, owner_id long, visibility string, status string")
    users = spark.createDataFrame([(0,), (1,), (7,)], "user_id long")
    live = [(i, i % 3, i % 4 == 0) for i in range(12) if i != 8]
    got = {(r.user_id, r.doc_id, r.kind, r["rank"]) for r in R.document_list(docs, users, 4).collect()}
    want = set()
    for u in (0, 1, 7):
        seen = sorted(((d, "own" if o == u else "shared") for d, o, s in live if o == u or s), reverse=True)[:4]
        want |= {(u, d, kind, n + 1) for n, (d, kind) in enumerate(seen)}
    assert got == want
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, 7)], "query_id long, user_id long")
    named = spark.createDataFrame([(1, 3), (1, 5), (1, 8), (2, 4), (2, 4)], "query_id long, doc_id long")
    got = sorted((r.query_id, r.doc_id) for r in R.scoped(asked, named, R.permitted(docs)).collect())
    assert got == [(1, 3), (2, 4), (3, 0), (3, 4)]


def test_hints_name_pages(spark):
    chunks = spark.createDataFrame([(1, 1, "Vana K-17 sökülür"), (2, 3, "Pompa ve K 17 ayarı"), (2, 5, "k-17 yedek"), (2, 6, "17 nolu"), (3, 1, "başka")], "doc_id long, page_no int, text string")
    asked = spark.createDataFrame([(1, "K17 değil Vana nerede"), (2, "Pompa K-17 var mı")], "query_id long, text string")
    targets = spark.createDataFrame([(1, 3), (2, 3)], "query_id long, doc_id long")
    got = sorted((r.query_id, r.term, r.doc_id, r.pages) for r in R.term_hints(asked, targets, chunks).collect())
    assert got == [(1, "Vana", 1, [1]), (2, "K-17", 1, [1]), (2, "K-17", 2, [3, 5, 6]), (2, "Pompa", 2, [3])]


def test_contextual_text_reset_and_totals(spark, tmp_path):
    df = spark.createDataFrame([("t", "s", "x"), ("t", "", "x"), (None, "s", "x"), ("", None, "x")], "a string, b string, c string")
    assert [r.y for r in df.select(D.contextual(F.col("a"), F.col("b"), F.col("c")).alias("y")).collect()] == ["t — s\n\nx", "t\n\nx", "s\n\nx", "x"]
    tables = I.reset({"documents": df, "votes": df}, ["votes"])
    assert tables["documents"].count() == 4 and tables["votes"].count() == 0 and tables["votes"].columns == df.columns
    with pytest.raises(ValueError):
        I.reset({"documents": df}, ["nothing"])
    events = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "user_id long, value double")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.running_totals(S.read_folder(spark, f"{tmp_path}/in", events.schema))
    got = {r.user_id: (r.runs, r.cost) for r in S.run_to_folder(stream, f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    assert got == {u: (10, float(sum(range(u, 30, 3)))) for u in range(3)}
