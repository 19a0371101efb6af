import math
import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import mixing as M

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType())])


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > 2 * sizes[s]]
        if not above:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def brute_rate(sizes, target):
    """Rates min(2, exp(t * size / mean)) that meet a target, by bisection."""
    mean, low, high = sum(sizes) / len(sizes), -700.0, 700.0
    for _ in range(200):
        t = (low + high) / 2
        value = sum(s * min(2.0, math.exp(min(50, t * s / mean))) for s in sizes)
        low, high = (low, t) if value > target else (t, high)
    return t


def make(rng, spec):
    rows, d = [], 0
    for source, n, top in spec:
        for _ in range(n):
            rows.append((d, " ".join("w" for _ in range(rng.randrange(top))), source))
            d += 1
    return rows


def check(spark, rows, near):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = M.mixture(df).collect()
    assert len(got) == len(rows)
    sizes, taken, by = defaultdict(int), defaultdict(int), {}
    source = {d: s for d, _, s in rows}
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        by[r.doc_id] = r
        assert r.size == 0 and r.taken == 0 or r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
    for s in sizes:
        longest = max(r.size for r in got if source[r.doc_id] == s)
        assert abs(taken[s] - want[s]) <= near * max(want[s], 1) + longest / 2, (s, taken[s], want[s])
    assert sorted(M.mixture(df.repartition(3)).collect()) == sorted(got)
    return got


def test_targets_and_taken(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP_ROWS", 50)
    rng = random.Random(4)
    rows = make(rng, [("b", 400, 60), ("a", 90, 300), ("Z", 60, 40), ("é", 70, 90), (None, 80, 50), ("\U0001f600", 50, 30), ("ﬀ", 40, 20)])
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, " ".join("x" * 5000), "b"), (9003, "\x85  ", "a"), (9004, None, "only empty")]
    check(spark, rows, 0.02)


def test_one_source_and_empty(spark):
    check(spark, make(random.Random(1), [("a", 30, 50)]), 0.02)
    assert M.mixture(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in M.mixture(spark.createDataFrame([(1, None, None, "")], SCHEMA)).collect()] == [0]


def test_targets_by_brute_force(spark):
    rng = random.Random(12)
    for n in (1, 2, 3, 4, 7, 20):
        sizes = {f"s{i:02}": rng.choice([0, 1, 10, 100, 100, 1000, 5000]) + 1 for i in range(n)}
        got = M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) for r in got), sizes


def test_newton_finds_the_dual(spark):
    rng = random.Random(6)
    sizes = {s: [rng.randrange(1, 400) for _ in range(200)] for s in "abcd"}
    share = {"a": 0.02, "b": 0.7, "c": 1.6, "d": 1.95}
    cells = spark.createDataFrame([(s, x, 1) for s in sizes for x in sizes[s]], "source string, size long, n long").groupBy("source", "size").sum("n").toDF("source", "size", "n")
    targets = spark.createDataFrame([(s, sum(v), share[s] * sum(v)) for s, v in sizes.items()], "source string, source_size long, target double")
    for r in M.tilts(cells, targets).collect():
        assert abs(r.tilt - brute_rate(sizes[r.source], share[r.source] * sum(sizes[r.source]))) < 1e-3 * max(1, abs(r.tilt))


def test_mixed_rows_follow_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP_ROWS", 20)
    rows = make(random.Random(8), [("a", 60, 30), ("b", 60, 90), ("c", 60, 60)]) + [(3, "same twice", "a"), (3, "same twice", "a"), (None, "no id", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want = defaultdict(int)
    for r in M.copies(df).collect():
        want[r.doc_id] += r.copies
    got = defaultdict(int)
    for r in M.mixed(df).collect():
        got[r.doc_id] += 1
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert M.mixed(df).columns == df.columns


def test_mixed_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "times", "of", "mark", "row", "copy", "own", "id", "nth", "_mark"]
    df = spark.createDataFrame([(i, "a b c", "s", *[f"{n}{i}" for n in names[3:]]) for i in range(40)], names)
    got = M.mixed(df)
    assert got.columns == names
    rows = got.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names[3:])


def test_many_equal_rows_take_their_share(spark):
    equal = spark.range(300_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("big").alias("source"))
    bare = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("big").alias("source"))
    other = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.lit("small").alias("source"))
    got = M.mixture(equal.unionByName(bare).unionByName(other))
    rows = got.groupBy("target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert sorted(r.n for r in rows) == [500, 320_000]
    assert all(abs(r.taken - r.target) <= 0.01 * r.target and r.over <= 0 for r in rows)
    again = M.mixture(equal.unionByName(bare).unionByName(other).repartition(7))
    count = lambda df: sorted(df.groupBy("doc_id", "size", "taken").count().collect(), key=str)
    assert count(got) == count(again)
