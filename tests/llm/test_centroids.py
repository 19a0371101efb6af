import hashlib

import numpy as np
from pyspark.sql import types as T

from scriptorium.llm import centroids as C

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType())])


def brute(rows, k=40, rounds=5):
    kept = [(i, [min(max(int(np.floor(float(x) * 256)), -C.MOST), C.MOST) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cent = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        own = [[] for _ in cent]
        for _, v in kept:
            own[near(v)[1]].append(v)
        cent = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, cent, strict=True)]
    told = [(i, *near(v)) for i, v in kept]
    by = {}
    for _, d, c in told:
        by[c] = by.get(c, 0) + d
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, d, long(by[c]), long(sum(by.values())), hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, d, c in told), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in C.cluster(df).collect()), key=str)


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)) + 3 * rng.integers(0, 2, (n, 1))
    return [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(x)]


def test_matches_brute_force_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)
    rows = vectors(150)
    rows += [(500 + i, rows[3][1]) for i in range(60)] + [(3, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    rows += [(600, None), (601, [1.0] * 63), (602, [1.0] * 65), (603, [1.0] * 63 + [None]), (604, [float("nan")] * 64), (605, [1.0] * 63 + [float("inf")]), (606, []), (607, [0.0] * 64)]
    assert run(spark, rows) == brute(rows)


def test_huge_components_stay_exact(spark):
    rows = vectors(60, 2) + [(700, [3e38] * 64), (701, [-3e38] * 64), (702, [400_000.5] * 64)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    rows = vectors(3)
    assert run(spark, rows) == brute(rows)


def test_places_follow_a_curve():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = C.hilbert_keys(cells, 3)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == side**3
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_never_lose_the_nearest():
    rng = np.random.default_rng(3)
    fewer = 0
    for _ in range(200):
        x = rng.integers(-20, 20, (30, 4)) + rng.integers(-200, 200, 4)
        cent = rng.integers(-200, 200, (12, 4))
        near = C.candidates(x.min(axis=0), x.max(axis=0), cent)
        fewer += len(near) < 12
        best, d = C.assigned(x, cent)
        some, e = C.assigned(x, cent[near])
        assert (near[some] == best).all() and (d == e).all()
    assert fewer > 150
