import random

import numpy as np
import pytest
from pyspark.sql import types as T

from scriptorium.llm import minhash as M

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("no", T.StringType())])


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=str)


def texts(n=25, copies=12):
    rng = random.Random(3)
    rows = []
    for b in range(n):
        size = rng.choice([4, 5, 6, 9, 14, 40, 120, 400])
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, max(1, size // 40)])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(1, 3)]
            rows.append((len(rows), " ".join(w).title() if rng.random() < 0.2 else "\n".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\x0b"), (903, "one two"), (904, "ONE two"), (905, "one"), (906, "one two three four"), (5, rows[5][1]), (5, "another text of this id"), (None, rows[7][1]), (None, "alone here with no id"), (None, "alone here with no id"), (907, "İ ı é\x1cx É"), (908, " ".join(f"v{i % 977}" for i in range(60000)))]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in M.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("listed", [32, 0])
def test_matches_brute_force_with_odd_rows(spark, monkeypatch, listed):
    monkeypatch.setattr(M, "LISTED", listed)
    monkeypatch.setattr(M, "TILE_ROWS", 4)
    rows = texts()
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(2)
    for n, shared in [(2000, 1600), (2000, 400), (300, 280), (5000, 0), (40, 30)]:
        got = []
        for _ in range(40):
            x = np.unique(rng.integers(0, 2**64 - 1, 2 * n, dtype=np.uint64))
            rng.shuffle(x)
            a, b = np.sort(x[:n]), np.sort(np.r_[x[:shared], x[n : 2 * n - shared]])
            got.append(M.estimate(M.sketch(a)[None], M.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(got) - shared / (2 * n - shared)) < 0.03


def test_registers_hold_leading_zeros_and_mantissa():
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    got = M.sketch(x)
    for b in range(M.REGISTERS):
        rest = min(int(v) << 8 & (2**64 - 1) for v in x if int(v) >> 56 == b) | 1
        zeros = 64 - rest.bit_length()
        assert got[b] == zeros << 10 | (rest << zeros + 1 & (2**64 - 1)) >> 54


def test_tiles_count_common_elements():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(30)]
    left, right = np.arange(0, 20), np.arange(10, 30)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert M._common(sets, left, right, columns=7).tolist() == want
