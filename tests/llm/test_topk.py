import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import topk as K

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute(rows, k):
    clean = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in clean), default=0)
    clean = [(i, np.r_[v, np.zeros(dims - len(v), np.int64)]) for i, v in clean]
    out = []
    for n, (q, own) in enumerate(clean):
        if q % 20 == 0:
            found = sorted(((-int(np.dot(own, v)), i) for m, (i, v) in enumerate(clean) if m != n))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    v = df.where(K.usable(F.col("embedding"))).select("vec_id", K.quantized(F.col("embedding")).alias("vector"))
    return sorted(tuple(r) for r in K.top_k(v, v.where("vec_id % 20 = 0"), k).collect())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "TREE_ROWS", 100)
    monkeypatch.setattr(K, "PAGE_ROWS", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, [100.0] * 8), (2020, [0.0] * 8), (2040, [1.0, 2.0]), (40, rows[3][1])]
    rows += [(3000, None), (3020, [1.0, None]), (3040, [float("nan")] * 8), (3060, [float("inf")] * 8), (None, [1.0] * 8), (3080, [])]
    assert run(spark, rows) == brute(rows, 20)


def test_few_rows_and_empty(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_BYTES", 160)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(300)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_rows_that_repeat_an_id_are_candidates_of_each_other(spark):
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.25]), (20, [1.0, 0.25]), (1, [0.5, 0.5]), (2, [2.0, 2.0])]
    got = run(spark, rows, 2)
    assert got == brute(rows, 2) and len(got) == 6
