from pyspark.sql import functions as F

from scriptorium.operators import chunking as D
from scriptorium.operators import layout as L
from scriptorium.operators import retrieve as R
from scriptorium.sources import index as I
from scriptorium.streaming import jobs as S


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")


def chunks(spark, most, overlap, least, *texts):
    units = L.label_runs(L.units(L.strip_edges(pages(spark, *texts)), most))
    return D.chunk(units, most, overlap, least).orderBy("ordinal").collect()


def test_chunks_lose_nothing_and_are_bounded(spark):
    text = "\n".join(f"Cümle {i} burada bitiyor ve devamı geliyor." for i in range(60))
    got = chunks(spark, 300, 60, 50, "MADDE 1 - İLK\n" + text, "MADDE 2 - İKİ\n" + text.replace("Cümle", "Tümce"))
    assert all(len(c.text) <= 300 + 60 + 20 for c in got)
    whole = " ".join(c.text for c in got)
    assert all(f"Cümle {i} " in whole for i in range(60))
    second = next(c for c in got if c.section and "MADDE 2" in c.section)
    assert second.text.startswith("MADDE 2")  # overlap never crosses a section
    assert [c.ordinal for c in got] == list(range(len(got)))


def test_alternating_headings_and_letters_stay(spark):
    got = chunks(spark, 2400, 300, 200, "\n".join(x for i in range(12) for x in (f"MADDE {i} - KONU", chr(97 + i))))
    whole = "\n".join(c.text for c in got)
    assert all(f"MADDE {i} " in whole for i in range(12)) and all(chr(97 + i) in whole for i in range(12))


def test_repeated_edges_spare_articles(spark):
    got = L.strip_edges(pages(spark, "Depo El Kitabı\nmd. 12 raflar\nüst raf boş\norta\np\nr\n31", "Depo El Kitabı\nmd. 13 raflar\nalt raf dolu\ns\nt\nu\n32")).collect()
    lines = [r.line for r in got]
    assert "md. 12 raflar" in lines and "md. 13 raflar" in lines and "Depo El Kitabı" not in lines and "31" not in lines


def test_label_runs(spark):
    units = L.label_runs(L.units(L.page_lines(pages(spark, "GİRİŞ VANASI\nANA TANK\nÇIKIŞ HATTI\nTank her sabah ölçülür.\nYEDEK PARÇA\nEK BİLGİ\nSon.")), 100)).orderBy("line_no").collect()
    assert [(u.text, u.heading) for u in units][:2] == [("[şema/kutu etiketleri: GİRİŞ VANASI · ANA TANK · ÇIKIŞ HATTI]", None), ("Tank her sabah ölçülür.", None)]
    assert [u.heading for u in units][2:4] == ["YEDEK PARÇA", "EK BİLGİ"]


def test_section_names(spark):
    df = spark.createDataFrame([(["a · b", "b", "c", "d"],)], "n array<string>")
    assert df.select(D.section_name(F.col("n")).alias("s")).first().s == "a · b · c …"


def words(spark, rows):
    return spark.createDataFrame([(1, t, float(a), float(b), float(y), float(y + 10)) for t, a, b, y in rows], "page_id long, text string, x0 double, x1 double, top double, bottom double")


def test_two_columns(spark):
    rows = [("title", 70, 430, 20)]
    for i in range(14):  # uneven lines of two words a column
        rows += [(f"a{i}", 40, 120, 50 + i * 15), (f"b{i}", 130, 200 + i % 3, 50 + i * 15), (f"c{i}", 260 - i % 2, 330, 50 + i * 15), (f"d{i}", 340, 450, 50 + i * 15)]
    df, size = words(spark, rows), spark.createDataFrame([(1, 500.0)], "page_id long, width double")
    bounds = L.column_boundary(df, size)
    assert 202 <= bounds.first().boundary <= 259
    lines = L.reading_order(df, bounds).first().text.split("\n")
    assert lines == ["title"] + [f"a{i} b{i}" for i in range(14)] + [f"c{i} d{i}" for i in range(14)]
    single = words(spark, [(f"s{i}", 40 + i, 460, 50 + i * 15) for i in range(25)])
    assert L.column_boundary(single, size).count() == 0


def test_markdown(spark):
    cells = [(1, 0, 0, "Port"), (1, 0, 1, "Kapasite"), (1, 1, 0, "T1"), (1, 1, 1, "15|840\nx"), (1, 2, 0, "E1"), (1, 3, 0, " "), (2, 0, 0, "one")]
    got = L.markdown(spark.createDataFrame(cells, "table_id long, row int, col int, cell string")).collect()
    assert [r.markdown for r in got] == ["| Port | Kapasite |\n| --- | --- |\n| T1 | 15\\|840 x |\n| E1 |  |"]


def test_scope_comes_before_rank(spark):
    docs = spark.createDataFrame([(1, "gecikme cezası cezası cezası"), (2, "gecikme cezası ve teslim süresi"), (3, "başka konu")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "gecikme cezası nedir")], "query_id long, text string")
    scope = spark.createDataFrame([(7, 2), (7, 3)], "query_id long, doc_id long")
    assert R.bm25(asked, docs, 1).first().doc_id in (1, 2)
    assert {r.doc_id for r in R.bm25(asked, docs, 5, scope=scope, idf_scope="corpus").collect()} == {2}


def test_budget_keeps_a_floor(spark):
    long = spark.createDataFrame([(1, i + 1, 4000) for i in range(40)] + [(2, i + 1, 300) for i in range(60)], "query_id long, rank int, chars long")
    n = {r.query_id: r["count"] for r in R.char_budget(long).groupBy("query_id").count().collect()}
    assert n == {1: 8, 2: 40}


def test_soft_delete_and_append(spark):
    docs = spark.createDataFrame([(1, "ready", "s"), (2, "ready", "s")], "doc_id long, status string, summary string")
    chunks_ = spark.createDataFrame([(1, 0, "summary", "", "ö", False), (1, 0, "body", "", "t", False), (2, 0, "body", "", " ", False)], "doc_id long, ordinal int, kind string, section string, text string, deleted boolean")
    d, p, c = I.soft_delete(docs, pages(spark, "x"), chunks_, spark.createDataFrame([(1,), (1,)], "doc_id long"))
    assert {(r.doc_id, r.status, r.summary) for r in d.collect()} == {(1, "deleted", None), (2, "ready", "s")}
    assert p.count() == 0 and {(r.text, r.deleted) for r in c.where("doc_id = 1").collect()} == {("", True)}
    added = I.append_index(chunks_.drop("deleted"), spark.createDataFrame([(2, False), (1, True)], "doc_id long, deleted boolean"))
    assert sorted((r.doc_id, r.ordinal, r.kind) for r in added.collect()) == [(1, 0, "summary"), (1, 1, "body")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], f"text {i % 7}" if i % 5 else " ") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, owner_id string, text string")
    for i in range(2):
        df.where(F.col("doc_id") % 2 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        S.stream_ingest(S.read_folder(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/store", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/store").where("status = 'ready'").select("owner_id", "sha256").collect()
    want = S.new_uploads(df, spark.createDataFrame([], "owner_id string, sha256 string")).where("status = 'ready'").select("owner_id", "sha256").collect()
    assert sorted(got) == sorted(want)
