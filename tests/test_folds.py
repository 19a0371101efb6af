"""Folds and sweeps against plain versions that look at everything anew."""

import random
import time
import tracemalloc

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import chunking as D
from scriptorium.operators import folds as Z
from scriptorium.operators import layout as L

WORDS = st.lists(st.sampled_from(["a", "bb", "ccc dd", "eeee ffff gg", "hhhhhhhhhhhh", ""]), max_size=5).map(" ".join)
UNITS = st.lists(st.tuples(WORDS, st.one_of(st.none(), st.integers(1, 4)), st.sampled_from([None, None, None, "A", "B", "A · C"])), max_size=14)


def plain_pack(units, most, overlap, least):
    groups = []
    for u in units:
        if u[2] is not None or not groups:
            groups.append([])
        groups[-1].append(u)
    out = []
    for group in groups:
        done, now, a, b = [], "", None, None
        for text, page, _ in group:
            full = now != "" and len(now) + len(text) > most
            if full:
                done.append([group[0][2], now, a, b])
            base = (D_tail(now, overlap) if overlap else "") if full else now
            a, now, b = (b if full else a if a is not None else page), (f"{base} {text}" if base else text), page
        if now and done and len(now) < least:
            done[-1] = [done[-1][0], done[-1][1] + " " + now, done[-1][2], b]
        elif now:
            done.append([group[0][2], now, a, b])
        out += done
    return out


def D_tail(text, size):
    end = text[-size:] if len(text) > size else text
    return text if len(text) <= size else end.split(" ", 1)[1] if " " in end else end


def plain_crumbs(chunks, crumb):
    done = []
    for section, text, a, b in chunks:
        leading = len(done) == 1 and len(done[0][1]) <= crumb
        if done and (leading or len(text) <= crumb):
            old = done.pop()
            done.append([section if leading else old[0], old[1] + "\n" + text, old[2], b])
        else:
            done.append([section, text, a, b])
    return done


def plain_merge(chunks, least, most):
    done = []
    for section, text, a, b in chunks:
        if done and (len(done[-1][1]) < least or len(text) < least) and len(done[-1][1]) + len(text) + 1 <= most:
            old = done.pop()
            names = []
            for n in f"{old[0] or ''} · {section or ''}".split(" · "):
                if n and n not in names:
                    names.append(n)
            done.append([" · ".join(names[:3]) + (" …" if len(names) > 3 else ""), old[1] + "\n" + text, old[2], b])
        else:
            done.append([section, text, a, b])
    return done


def told(chunks):
    return [[c.section, "".join(c.parts), c.first, c.last] for c in chunks]


@settings(max_examples=400, deadline=None)
@given(UNITS, st.integers(2, 30), st.integers(0, 8), st.integers(0, 10), st.integers(0, 6))
def test_folds_equal_plain_ones(units, most, overlap, least, crumb):
    packed = plain_pack(units, most, overlap, least)
    assert told(Z.packed(units, most, overlap, least)) == packed
    crumbs = plain_crumbs(packed, crumb)
    assert told(Z.without_crumbs(Z.packed(units, most, overlap, least), crumb)) == crumbs
    got = Z.merged(Z.without_crumbs(Z.packed(units, most, overlap, least), crumb), least, most)
    assert told(got) == plain_merge(crumbs, least, most)
    assert all(c.size == len("".join(c.parts)) for c in got)


def test_windows_never_split_a_page():
    assert Z.window_numbers([10, 0, 95, 5, 200, 0, 1], 100) == [0, 0, 1, 1, 2, 3, 3]
    assert Z.window_numbers([], 100) == []


def test_lines_of_words():
    assert Z.line_text([(10.0, 50.0, "b"), (12.0, 5.0, "a"), (14.0, 5.0, "c"), (None, 1.0, "t"), (11.0, 9.0, "")], 3.0) == "t\na b\nc"
    assert Z.line_text([], 3.0) == ""


def plain_split(text, most):
    out = []
    for w in text.split():
        if out and len(out[-1]) + 1 + len(w) <= most:
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def test_hard_split_equals_greedy_words(spark):
    rng = random.Random(5)
    texts = [" ".join("ağ😀b"[rng.randrange(4)] * rng.choice([1, 2, 3, 7, 30]) for _ in range(rng.randrange(40))) for _ in range(150)] + ["", "   ", "x  y\n\nz", "w" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for most in (1, 2, 9, 20):
        for r in df.select("t", L.hard_split(F.col("t"), most).alias("p")).collect():
            assert r.p == plain_split(r.t, most)


def test_columns_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, page_no int, line_no int, part int, text string, heading string")
    assert D.chunk(none).count() == 0 and D.page_windows(none).count() == 0
    odd = spark.createDataFrame([(1, 1, 1, 0, None, None), (1, 1, 2, 0, "", "A"), (2, 1, 1, 0, "x", None)], none.schema)
    assert [(r.doc_id, r.section, r.text) for r in D.chunk(odd).collect()] == [(2, None, "x")]


def test_a_document_of_many_lines(spark):
    """200,000 lines, among them one of 200,000 words; the folds of before took minutes."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("Satır "), F.col("id").cast("string"), F.lit(" "), i.cast("string"), F.lit(" burada biter."))), "\n")
    pages = spark.range(4000).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"), lines.alias("text"))
    begun = time.time()
    got = D.chunk(L.units(L.page_lines(pages), 1200), 300, 60, 50)
    said = got.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"), F.max("page_end").alias("last")).first()
    assert said.n > 20_000 and said.longest <= 300 + 60 + 50 and said.last == 4000
    assert D.page_windows(pages, 3000).count() == 4000
    words = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: i.cast("string")), " ").alias("t"))
    pieces = words.select(F.explode(L.hard_split(F.col("t"), 400)).alias("p")).agg(F.max(F.length("p")).alias("m"), F.sum(F.size(F.split("p", " "))).alias("w")).first()
    assert pieces.m <= 400 and pieces.w == 200_000
    assert time.time() - begun < 60


def plain_gutter(words, width):
    step, best = max(2.0, width / 150), None
    for i in range(int(width * 0.4 / step) + 1):
        x = width * 0.3 + i * step
        left, right = [b for a, b in words if b <= x], [a for a, b in words if a >= x]
        crossing = sum(a < x < b for a, b in words)
        if len(words) >= 20 and crossing <= max(2, len(words) * 0.02) and min(len(left), len(right)) >= len(words) * 0.15 and min(right) - max(left) >= 12:
            key = (round(min(right) - max(left), 6), -x)
            best = max(best or (key, x), (key, x))
    return best and best[1]


def test_gutter_equals_trying_every_candidate(spark):
    rng = random.Random(11)
    pages, sizes = [], []
    for page in range(120):
        width = rng.choice([150.0, 300.0, 600.0, 611.7, 900.3])
        middle, gap = width * rng.uniform(0.3, 0.7), rng.uniform(6, 40)
        for _ in range(rng.choice([15, 20, 40, 90])):
            long = rng.uniform(0, width * 0.2)
            x0 = rng.uniform(0, max(1.0, middle - gap / 2 - long)) if rng.random() < 0.5 else rng.uniform(middle + gap / 2, width)
            if rng.random() < 0.02:
                x0, long = middle - 30, 60.0
            if rng.random() < 0.3:  # on a candidate
                x0 = width * 0.3 + round((x0 - width * 0.3) / max(2.0, width / 150)) * max(2.0, width / 150)
            pages.append((page, x0, x0 + (0.0 if rng.random() < 0.05 else long)))
        sizes.append((page, width))
    words = spark.createDataFrame(pages, "page_id long, x0 double, x1 double").withColumn("text", F.lit("w"))
    got = {r.page_id: r.boundary for r in L.column_boundary(words, spark.createDataFrame(sizes, "page_id long, width double")).collect()}
    want = {p: plain_gutter([(a, b) for q, a, b in pages if q == p], w) for p, w in sizes}
    assert got == {p: x for p, x in want.items() if x is not None} and len(got) > 10


def test_pages_are_dealt_over_as_many_tasks_as_their_words_ask_for(spark, monkeypatch):
    """However small their rows are on the wire, adaptive execution doesn't join what one task can't hold."""
    words = spark.range(0, 9000, 1, 3).selectExpr("id % 150 AS page_id", "'w' AS text", "IF(id < 4500, 60D, 330D) AS x0", "IF(id < 4500, 110D, 380D) AS x1")
    sizes = spark.range(150).selectExpr("id AS page_id", "600D AS width")
    monkeypatch.setattr(L, "WORDS", 500)
    for tasks in (None, 18):
        found = L.column_boundary(words, sizes, tasks) if tasks else L.column_boundary(words, sizes)
        assert found.rdd.getNumPartitions() == 18 and found.count() == 150


def test_folds_hold_few_documents_as_objects(monkeypatch):
    """Slices give what the whole batch gives, and a batch of 3,000 documents isn't held as Python objects."""
    made = []
    monkeypatch.setattr(Z.F, "arrow_udf", lambda f, kind: made.append(f) or (lambda lists: lists))
    Z.fold(None, ("text", "page", "section"), lambda rows: Z.packed(rows, 120, 30, 20))
    units = [[{"text": f"line {i} " * 5, "page": j, "section": f"s{j}" if j % 9 == 0 else None} for j in range(i % 40)] for i in range(3000)] + [None, []]
    lists = pa.array(units, pa.list_(pa.struct([("text", pa.string()), ("page", pa.int32()), ("section", pa.string())])))
    tracemalloc.start()
    got = made[0](lists)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(Z, "SLICE", 10_000, raising=False)
    assert got.equals(made[0](lists)) and most < 4 << 20


def test_a_long_line_is_looked_at_once_not_for_each_of_its_parts(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, ("A long line of many words. " * 90).strip()), (1, 1, 2, "MADDE 4 Title")], "doc_id long, page_no int, line_no int, line string").write.parquet(f"{tmp_path}/lines")
    cut = L.units(spark.read.parquet(f"{tmp_path}/lines"), 1200)
    plan = cut._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert not any("RLIKE" in line for line in plan[:at]), "\n".join(plan)  # what stands over the explode runs once a part
    assert any("RLIKE" in line for line in plan[at + 1 :])
    rows = cut.orderBy("line_no", "part").collect()
    assert [r.heading for r in rows] == [None] * 90 + ["MADDE 4 Title"] and rows[7].text == "A long line of many words."
