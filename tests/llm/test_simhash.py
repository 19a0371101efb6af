import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import simhash as S
from scriptorium.llm.graph import connected_components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "Beta", "gAmma", "delta", "éa", "zz", "x1", "q"]) for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        w = base[k % 20].split(" ")
        w[rng.randrange(200)] = "edited"
        rows.append((100 + k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "one"), (305, "ONE two"), (5, base[5]), (None, base[6]), (306, base[0] * 40), (307, "  İ İ")]
    return rows


def test_matches_brute_force_with_odd_rows(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_hot_buckets_are_divided_without_loss(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_BUCKET", 3)
    rows = texts()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_close_pairs_matches_popcount():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in centres]))
    u, v = S.forest(np.zeros(len(fps), dtype=np.int64), fps, 2)
    label = {int(x): int(x) for x in fps}
    label.update({int(a): int(b) for a, b in zip(u, v, strict=True)})
    assert len(set(label.values())) == 6


def test_every_pair_in_one_block():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 256, 150, dtype=np.uint64)
    fps = np.unique(fps)
    planes = S._planes(fps)
    n, blocks = len(fps), planes.shape[1]
    q = np.repeat(np.arange(n), blocks)
    a, b = S.close_pairs(fps, np.tile(np.arange(blocks), n), q, 2, planes)
    want = {(i, j) for i in range(n) for j in range(n) if j > i and bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d", "x"), (5, "a b c d", "y"), (5, "other words here now", "z"), (7, "Other words here now", "u"), (None, "a b c d", "v"), (None, "alone in this world", "w"), (None, "alone in this world", "w"), (9, None, "p"), (8, "", "q"), (9, None, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumn("root", F.lit(1))
    got = S.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text), r.mark) for r in got.collect()) == sorted([("3", "a b c d", "x"), ("5", "other words here now", "z"), ("None", "alone in this world", "w"), ("8", "", "q")])
    assert S.one_of_each(df.limit(0)).count() == 0


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5100)] + [(2999, 5000), (7000, 7000), (8001, 8000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys([*range(1, 3000), *range(5000, 5101)], 0), 8001: 8000}
