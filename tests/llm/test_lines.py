import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import lines as L

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.IntegerType())])


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and d is not None:
                holders[key(x)].add(d)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    out = L.drop_repeated(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    shared = ["Shared line number %d with a good many characters é" % i for i in range(6)]
    rows = []
    for d in range(60):
        body = [rng.choice(shared) if rng.random() < 0.3 else f"own line {d} {i} " + "x" * rng.randrange(60) for i in range(rng.randrange(1, 12))]
        rows.append((d, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, shared[0].upper() + "\n \t" + shared[0] + "\r\n"), (103, shared[0]), (7, rows[7][1]), (None, shared[1] + "\nown")]
    rows += [(200 + i, "y" * 40 + "\n" + "z" * 39) for i in range(4)] + [(300 + i, "w" * 40) for i in range(5)]
    rows += [(500 + i % 2, f"{'v' * 50}\n{i}") for i in range(8)] + [(510 + i % 5, f"{'u' * 50}\n{i}") for i in range(8)]  # texts of two and of five ids
    rows += [(400, "\n".join([shared[2]] * 3000))]
    assert run(spark, rows) == brute(rows)


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAST_BITS", 1 << 16)
    monkeypatch.setattr(L, "MOST_BITS", 1 << 16)
    rows = [(i, "\n".join(f"line {j} {'abc' * 20}" for j in range(i * 50, i * 50 + 400))) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_only_null_ids(spark):
    assert run(spark, []) == []
    rows = [(None, f"{'k' * 50}\n{i}") for i in range(6)]
    assert all(r[2] == 0 for r in run(spark, rows))
