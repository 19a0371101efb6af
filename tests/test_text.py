import random
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import audit as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def each(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_needs_ocr(spark):
    cases = [("Depo anahtarları her akşam güvenlik görevlisine bırakılır ve deftere yazılır. " * 2, False), ("kısa", True), ("\t \r\n", True), ("", True), (None, True)]
    cases += [("|-+-| 12 | 34 | " * 40, True), ("okunan satırlar " * 12 + "�" * 3, False), ("okunan satırlar " * 12 + "�" * 12, True), ("ab" * 29 + "c", True), ("ab" * 30, False)]
    assert each(spark, [t for t, _ in cases], X.needs_ocr) == [want for _, want in cases]


def test_heading(spark):
    headings = ["MADDE 21 — DENETİM", "md. 3 süre", "YEDİNCİ BÖLÜM", "Bölüm IV Sonuç", "ARIZA BİLDİRİMİ", "4.1.2 Kalibrasyon adımları", "  KISIM 9  "]
    others = ["ab", "", None, "Cihaz kapatılmadan önce bütün vanalar elle sıkılır ve basınç göstergesi not edilir, sonra", "Tablo 4 ölçümler", "www.ornek.test", "E-posta: x@y", "12 34 56 78 kg", "A, B, C", "KABLO; FİŞ; PRİZ", "7.3 ölçüm 99999999.", "SATIR SONU,"]
    got = each(spark, headings + others, X.heading)
    assert all(got[: len(headings)]) and not any(got[len(headings) :])
    assert got[6] == "KISIM 9" and got[5] == "4.1.2 Kalibrasyon adımları"


def test_clean(spark):
    cases = [
        ("3 kg³ ve ¼ litre", "3 kg³ ve ¼ litre"), ("kalibras-\nyon", "kalibrasyon"), ("ara­\n  lık ve u­ç", "aralık ve uç"), ("café oﬃce ‘a’–“b”", "café office 'a'-\"b\""), ("x\r\ny\rz", "x\ny\nz"),
        ("p\n\n\n\n\nq", "p\n\nq"), ("bip\x07\x1f", "bip"), ("  a\t\tb  \n  c  \n", "a b\nc"), (" \n \n", ""), (None, None), ("", ""), ("a   b\n  \n c", "a   b\n\nc"),
    ]
    assert each(spark, [raw for raw, _ in cases], X.clean_text) == [clean for _, clean in cases]


def test_terms_and_titles(spark):
    assert each(spark, ["Iğdır İli; ve KAR-yağışı/rüzgar y", None, "", "...", "a1 B2! x", " çok uzun"], X.tokenize) == [["ığdır", "ili", "kar", "yağışı", "rüzgar"], None, [], [], ["a1", "b2"], ["uzun"]]
    assert each(spark, ["IRMAK KENARI İŞLETMELERİ T.A.Ş. RAPORU", "Irmak RAPORU", "ÖLÇÜM.", "", None], X.title_case) == ["Irmak Kenarı İşletmeleri T.A.Ş. Raporu", "Irmak RAPORU", "Ölçüm.", "", None]


def test_permille(spark):
    assert each(spark, ["oran %o 7", "‰o12", "%o", "%onay", "100 %", None], X.permille_fix) == ["oran ‰ 7", "‰12", "%o", "%onay", "100 %", None]


def test_citation_marks(spark):
    cases = [
        ("Pompa durur [4].", "Pompa durur."), ("Vana [2][9] ve conta [11] sıkılır.", "Vana ve conta sıkılır."), ("Ayrıntı ekte ([6]).", "Ayrıntı ekte."), ("| 7 bar [3] | açık [1] |", "| 7 bar | açık |"), ("ilk [8]\nson [9]", "ilk\nson"),
        ("[not](ek) ile [çizim: B]", "[not](ek) ile [çizim: B]"), ("[1] başta", "başta"), ("", ""), (None, None), ("dizi[0] kalır mı", "dizi kalır mı"),
    ]
    assert each(spark, [raw for raw, _ in cases], X.strip_citations) == [want for _, want in cases]


def test_short_answer(spark):
    mark = "**Kısa cevap:**"
    cases = [(f"Uzun açıklama.\n\nİkinci bölüm.\n\n{mark} Evet.", f"{mark} Evet.\n\nUzun açıklama.\n\nİkinci bölüm."), (f"{mark} ilk.\n\ngövde\n\n{mark} son.", f"{mark} son.\n\ngövde"), (f"x<br/>y\n\n{mark} z", f"{mark} z\n\nx · y"), (f"{mark} tek", f"{mark} tek"), ("işaretsiz", "işaretsiz"), (None, None)]
    assert each(spark, [raw for raw, _ in cases], X.short_answer_first) == [want for _, want in cases]


def test_duration(spark):
    assert each(spark, ["2h", "1m15s", "250ms", "0.5m", "12", "Mon, 3", "", "1h 2m 3s", None], X.parse_duration) == [7200.0, 75.0, 0.25, 30.0, 12.0, None, None, 3723.0, None]


def test_blocks_and_ratings(spark):
    assert each(spark, ["<reasoning a=b>uzun</reasoning> kısa", "önce <think>hiç kapanmaz", "<thinking>yalnız", "<THINK>a</THINK><think>b</think>son", None], X.strip_blocks) == ["kısa", "önce", "<thinking>yalnız", "son", None]
    assert each(spark, ["7", "0", "2.7", "beş", None, "nan", "-0.5"], X.clamp_rating) == [5, 1, 2, 3, 3, 3, 1]


def test_numbers(spark):
    cases = [("7.250", 7250), ("12.400.300", 12400300), ("8,125", 8125), ("3,5", 3.5), ("3.5", 3.5), ("0,042", 0.042), ("2.345,75", 2345.75), ("2,345.75", 2345.75), ("9.", 9), ("yok", None), (",25", 0.25), ("1.2.3,4", 123.4), ("", None), (None, None)]
    got = each(spark, [raw for raw, _ in cases], U.tr_number)
    assert [None if x is None else float(x) for x in got] == [want for _, want in cases]


def audit(spark, *answers):
    df = spark.createDataFrame(list(enumerate(answers)), "run_id long, answer string")
    return [(r.run_id, float(r.expected), float(r.written), r.ok) for r in U.calc_audit(U.calc_lines(df)).orderBy("run_id", "pos", "link").collect()]


def test_calculations(spark):
    got = audit(
        spark, "Hesap: 1.200 kg × %15 = 180 kg", "> **Hesap:** 90.000 TL × ‰4 × 10 gün = 3.600 TL (üst sınır)", "hesap： binde 8 × 2.000 = 16", "Hesap: 9,75 − 4,5 = 5,25 m", "Hesap: 7.000 × 0,002 × 30 = 42",
        "Hesap: 6 x 7 = 42 = 45", "Hesap: 50 kg > 40 kg → sınır\nHesap: toplam 90", "Hesap: -4 × 3 + 9 / 2 = -7,5", "Hesap: 10 / 3 = 3,33", "Hesap: 10 / 0 = 1", "Hesap: 5 = 5", "Hesap: 2 + = 3", "", "Hesap: 99.000 × 60 = 5.940.000 = 5.960.000",
    )
    assert [(n, ok) for n, _, _, ok in got] == [(0, True), (1, True), (2, True), (3, True), (4, False), (5, True), (5, False), (7, True), (8, True), (13, True), (13, False)]
    assert got[4][1:3] == (420.0, 42.0)


def test_brackets(spark):
    got = audit(
        spark, "Hesap: (12 + 8) × 3 = 60", "Hesap: 100 − (2 + 3) × (7 − 4) = 85", "Hesap: ((1 + 2) × (3 + 4)) / 2 = 10,5", "Hesap: -(4 − 9) = 5", "Hesap: 40 TL (tavan) + (2 × 5 TL) = 50 TL", "Hesap: (((((1 + 1))))) + 1 = 3", "Hesap: (1 + 2 = 3",
        "Hesap: (2.000 + 500,5) × %10 = 250,05", "Hesap: (1 / 0) + 1 = 2", "Hesap: (3 + 4) × 2 = 17",
    )
    assert [(n, ok) for n, _, _, ok in got] == [(0, True), (1, True), (2, True), (3, True), (4, True), (5, True), (7, True), (9, False)]


def test_brackets_by_brute_force(spark):
    getcontext().prec = 40
    rng = random.Random(4)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            n = rng.randrange(1, 60)
            return str(n), Decimal(n)
        (a, x), op, (b, y) = make(depth - 1), rng.choice("+-*"), make(depth - 1)
        value = x + y if op == "+" else x - y if op == "-" else x * y
        return f"({a} {op.replace('*', '×')} {b})", value

    cases = [make(4) for _ in range(150)]
    lines = [f"Hesap: {text[1:-1] if text.startswith('(') else text + ' + 0'} = {value}" for text, value in cases]
    got = audit(spark, *lines)
    assert [n for n, *_ in got] == list(range(150))
    assert all(ok and expected == float(cases[n][1]) for n, expected, _, ok in got)


def test_error_rates(spark):
    row = spark.createDataFrame([("kuru çay üç kap", "kuru cay üç kaplar da")], "a string, b string")
    got = row.select(U.char_error("a", "b").alias("c"), U.word_error("a", "b").alias("w"), U.diacritic_loss("a", "b").alias("d")).first()
    assert (got.c, got.w, got.d) == (7 / 15, 3 / 4, 1 / 3)


def test_word_error_of_a_long_pair(spark):
    words = [f"w{i}" for i in range(9000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(w if i % 1000 else f"x{i}" for i, w in enumerate(words)))], "a string, b string")
    assert df.select(U.word_error("a", "b").alias("w")).first().w == 9 / 9000
