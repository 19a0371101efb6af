import random
import time

from pyspark.sql import functions as F

from scriptorium.operators import audit as U
from scriptorium.operators import edits as E


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matches_the_table_of_distances():
    rng = random.Random(1)
    for _ in range(600):
        letters = rng.choice(["ab", "abcd", "aé😀퟿ "])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert E.distance(a, b) == table(a, b)
        assert E.distance(a.split(" "), b.split(" ")) == table(a.split(" "), b.split(" "))
        edited = "".join(c for c in a if rng.random() > 0.05) + "x"
        assert E.distance(a, edited) == table(a, edited) == E.distance(edited, a)


def test_long_pairs_take_seconds():
    rng = random.Random(2)
    a = [rng.choice("abcdefgh ") for _ in range(100_000)]
    b = list(a)
    for _ in range(500):
        b[rng.randrange(len(b))] = "#"
    began = time.time()
    changed = sum(x != y for x, y in zip(a, b, strict=True))
    assert E.distance("".join(a), "".join(b)) == changed
    words = [f"w{rng.randrange(40_000)}" for _ in range(30_000)]
    assert E.distance(words, [w if i % 100 else "?" for i, w in enumerate(words)]) == 300
    assert time.time() - began < 60


def test_rates_agree_on_both_paths(spark, monkeypatch):
    rows = [("abc def", "abd  def "), ("", ""), ("", "x"), ("kitten", "sitting"), (None, "a"), ("a b c d", "a c d e f"), ("x" * 300, "x" * 200 + "y" * 50)]
    df = spark.createDataFrame(rows, "a string, b string")
    short = [r.r for r in df.select(U.char_error("a", "b").alias("r")).collect()]
    monkeypatch.setattr(U, "SHORT", 0)
    assert [r.r for r in df.select(U.char_error("a", "b").alias("r")).collect()] == short
    assert short[3] == 3 / 6 and short[4] is None and short[2] == 1
    assert [r.r for r in df.select(F.round(U.word_error("a", "b"), 6).alias("r")).collect()][5] == 0.75


def test_brackets_of_any_depth(spark):
    lines = [("(" * d + "1+1" + ")" * d + "*2", 4) for d in (1, 3, 5, 6, 20)] + [("2*(3+(4-(5*(6-(7/(1+(0,5*2)))))))", 2 * (3 + (4 - (5 * (6 - 3.5))))), ("((1+1)", None), ("(((1+)))*2", None), ("-(2+3)*(4-(1))", -15), ("7", 7)]
    df = spark.createDataFrame([(x,) for x, _ in lines], "x string")
    got = [None if r.v is None else float(r.v) for r in df.select(U.evaluate(F.col("x"))["value"].alias("v")).collect()]
    assert got == [None if v is None else float(v) for _, v in lines]


def test_numbers_are_read_once(spark):
    """The expression of a step holds a number's reading once, not wherever its value stands."""
    assert str(U._flat(F.col("x"))._jc if hasattr(F.col("x"), "_jc") else U._flat(F.col("x"))).count("[.,]+$") == 1
    assert str(U.equal_as_written(F.col("a"), F.col("b"), F.col("c"))).upper().count("POWER") == 1
