"""Numeric audit of answers and error rates of transcriptions, as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import char_distance, word_distance

NUMBER = "decimal(38,10)"
DIACRITICS = "çğıöşüÇĞİÖŞÜ"
# What a calculation line, and a number or sign in it, look like. Answers are audited as they are written.
CALC_LINE = r"(?iumU)^[\s>*_\-•]*hesap\s*[:：]\s*(.+)$"
TOKEN = r"([‰%]?\d[\d.,]*[‰%]?|[×x*·/÷+\-−()])"
#: Marks between which a value stands for a bracket.
VALUE = "¤"


def _let(value: Column, use) -> Column:
    """use(value), evaluated once however often it stands in it."""
    return F.transform(F.array(value), use)[0]


def plain_number(c: Column) -> Column:
    """A number of either notation as plain text: the last of two kinds of separators is the decimal one."""
    return _let(F.regexp_replace(F.trim(c), r"[.,]+$", ""), _one_point)


def _one_point(t: Column) -> Column:
    dots, commas = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))), F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    both = F.when(comma_last, F.translate(t, ",.", ".")).otherwise(F.replace(t, F.lit(","), F.lit("")))
    whole, rest = F.regexp_extract(t, r"^([^.,]*)[.,]", 1), F.regexp_extract(t, r"[.,](.*)$", 1)
    single = F.when((F.length(rest) == 3) & ~whole.isin("", "0"), F.concat(whole, rest)).otherwise(F.concat(whole, F.lit("."), rest))
    return F.when(~t.rlike("[.,]"), t).when((dots > 0) & (commas > 0), both).when((dots > 1) | (commas > 1), F.translate(t, ".,", "")).when(dots + commas == 1, single).otherwise(t)


def tr_number(c: Column) -> Column:
    return plain_number(c).try_cast(NUMBER)


def scale_of(plain: Column) -> Column:
    return F.when(plain.contains("."), F.length(F.regexp_extract(plain, r"\.(\d*)$", 1))).otherwise(0)


def tr_format(c: Column) -> Column:
    """Two decimals at most, dots between thousands, a decimal comma."""
    two = F.format_number(c, 2)
    return F.translate(F.regexp_replace(F.regexp_replace(two, r"(\.\d*?)0+$", "$1"), r"\.$", ""), ",.", ".,")


def calc_lines(answers: DataFrame) -> DataFrame:
    """(run_id, pos, line, parts): the calculations of answers (run_id, answer), split at their equals signs."""
    found = F.regexp_extract_all(F.replace("answer", F.lit("**"), F.lit("")), F.lit(CALC_LINE), F.lit(1))
    rows = answers.select("run_id", F.posexplode(found).alias("pos", "line")).withColumn("line", F.trim("line"))
    cut = F.split(F.split("line", "→|=>|;")[0], "=")
    return rows.select("run_id", "pos", "line", F.filter(cut, lambda p: F.trim(p) != "").alias("parts")).where(F.size("parts") >= 2)


def _flat(text: Column) -> Column:
    """struct(value, last) of an expression without brackets: products before sums, signs, percent and per mille; value is null for other texts."""
    dec = lambda x: F.lit(x).cast(NUMBER)
    state = lambda s, t, op, sign, want, ok, last: F.struct(s.cast(NUMBER).alias("sum"), t.cast(NUMBER).alias("term"), op.alias("op"), sign.cast("int").alias("sign"), want.alias("want"), ok.alias("ok"), last.alias("last"))
    zero = state(dec(0), dec(0), F.lit("+"), F.lit(1), F.lit(True), F.lit(True), F.lit(""))

    def add(s: Column, tok: Column) -> Column:
        number = tok.rlike(r"\d")
        minus, plus, times, over = tok.rlike("^[-−]$"), tok == "+", tok.rlike("^[×x*·]$"), tok.rlike("^[/÷]$")
        raw = F.when(tok.contains(VALUE), F.translate(tok, VALUE, "")).otherwise(plain_number(F.translate(tok, "‰%", "")))
        unit = F.when(tok.contains("‰"), dec("0.001")).when(tok.contains("%"), dec("0.01")).otherwise(dec(1))

        def take(v: Column) -> Column:
            raw, x = v["raw"], v["x"]
            term = F.when(s["op"] == "*", (s["term"] * x).cast(NUMBER)).when(s["op"] == "/", F.try_divide(s["term"], x).cast(NUMBER)).otherwise(x.cast(NUMBER))
            base = F.when(s["op"] == "+", (s["sum"] + s["term"]).cast(NUMBER)).when(s["op"] == "-", (s["sum"] + s["term"]).cast(NUMBER)).otherwise(s["sum"])
            term = F.when(s["op"] == "-", -term).otherwise(term)
            return state(base, term, F.lit(""), F.lit(1), F.lit(False), s["ok"] & s["want"] & x.isNotNull(), raw)

        read = lambda raw: F.struct(raw.alias("raw"), ((raw.try_cast(NUMBER) * unit).cast(NUMBER) * s["sign"]).alias("x"))
        took = _let(_let(raw, read), take)
        sign = state(s["sum"], s["term"], s["op"], -s["sign"], F.lit(True), s["ok"], s["last"])
        op = F.when(plus, "+").when(minus, "-").when(times, "*").otherwise("/")
        chose = state(s["sum"], s["term"], op, F.lit(1), F.lit(True), s["ok"] & (plus | minus | times | over), s["last"])
        failed = state(s["sum"], s["term"], s["op"], s["sign"], s["want"], F.lit(False), s["last"])
        return F.when(number, took).when(s["want"] & minus, sign).when(~s["want"], chose).otherwise(failed)

    def finish(s: Column) -> Column:
        return F.struct(F.when(s["ok"] & ~s["want"], (s["sum"] + s["term"]).cast(NUMBER)).alias("value"), s["last"].alias("last"))

    tokens = F.regexp_extract_all(text, F.lit(rf"({VALUE}-?[\d.]+{VALUE}|{TOKEN[1:-1]})"), F.lit(1))
    return F.aggregate(tokens, zero, add, finish)


def _open_brackets(text: Column) -> Column:
    """The expression with each innermost bracket replaced by its value; one that can't be read leaves a bracket, which no flat expression has."""
    values = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.coalesce(F.concat(F.lit(VALUE), F.regexp_replace(_flat(x)["value"].cast("string"), r"\.?0+$", ""), F.lit(VALUE)), F.lit("(")))
    filled = F.array_join(F.zip_with(F.split(text, r"\([^()]*\)"), values, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.contains("("), filled).otherwise(text)


def evaluate(part: Column) -> Column:
    """struct(value, operations, last): an expression; brackets, products, sums, signs, percent and per mille.

    Units and remarks are left out. value is null where what is left is no expression;
    operations counts all signs; last is the last number as written.
    """
    worded = F.regexp_replace(F.regexp_replace(F.lower(part), r"binde\s*", "‰"), r"yüzde\s*", "%")
    timed = F.regexp_replace(worded, r"(?<=[\d\s])x(?=[\s\d])", "×")
    bare = F.regexp_replace(F.regexp_replace(timed, r"[^\d.,‰%×*·/÷+\-−()\s]", " "), r"\([\s.,]*\)", " ")

    def whole(text: Column) -> Column:
        brackets = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))  # each round opens one level at least
        opened = F.when(brackets > 0, F.aggregate(F.sequence(F.lit(1), brackets), text, lambda now, _: _open_brackets(now))).otherwise(text)
        found = _flat(opened)
        operations = F.size(F.regexp_extract_all(text, F.lit(r"([×*·/÷+\-−])"), F.lit(1)))
        return _let(found, lambda f: F.struct(f["value"].alias("value"), operations.alias("operations"), f["last"].alias("last")))

    return _let(bare, whole)


def equal_as_written(expected: Column, written: Column, last: Column) -> Column:
    """Within one unit of the last written place after rounding to it."""

    def near(unit: Column) -> Column:
        rounded = F.floor(expected / unit + F.lit("0.5").cast(NUMBER)).cast(NUMBER) * unit
        return F.abs(rounded.cast(NUMBER) - written) <= unit

    return _let(F.pow(F.lit(10.0), -scale_of(last)).cast(NUMBER), near)


def calc_audit(lines: DataFrame) -> DataFrame:
    """(run_id, pos, link, expected, written, ok): each right side against the value on its left.

    A right value goes on as the next expectation only if it is right; one that can't be read
    ends the line; a line whose left side can't be read, or does nothing, is skipped.
    """
    # the one-row explode keeps the optimizer from evaluating an expression again wherever it is used
    once = lines.select("run_id", "pos", F.explode(F.array(F.transform("parts", evaluate))).alias("vs"))
    valued = once.where(F.col("vs")[0]["value"].isNotNull() & (F.col("vs")[0]["operations"] > 0))
    none = F.struct(F.col("vs")[0]["value"].alias("expected"), F.lit(True).alias("live"), F.array().cast(f"array<struct<expected:{NUMBER},written:{NUMBER},ok:boolean>>").alias("out"))

    def add(s: Column, v: Column) -> Column:
        def go_on(ok: Column) -> Column:
            row = F.struct(s["expected"].alias("expected"), v["value"].alias("written"), ok.alias("ok"))
            return F.struct(F.when(ok, v["value"]).otherwise(s["expected"]).alias("expected"), F.lit(True).alias("live"), F.concat(s["out"], F.array(row)).alias("out"))

        ended = F.struct(s["expected"].alias("expected"), F.lit(False).alias("live"), s["out"].alias("out"))
        return F.when(s["live"] & v["value"].isNotNull(), _let(equal_as_written(s["expected"], v["value"], v["last"]), go_on)).otherwise(ended)

    links = F.aggregate(F.slice("vs", F.lit(2), F.size("vs")), none, add)["out"]
    return valued.select("run_id", "pos", F.posexplode(links).alias("link", "r")).select("run_id", "pos", "link", "r.*")


def calc_report(audit: DataFrame) -> DataFrame:
    return audit.groupBy("run_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("ok")).alias("wrong"))


def calc_missing(answers: DataFrame, audit: DataFrame) -> DataFrame:
    """(run_id, missing): whether a short answer states none of the results that its calculations wrote."""
    first = F.substring_index(F.trim(F.replace("answer", F.lit("**"), F.lit(""))), "\n\n", 1)
    said = F.transform(F.regexp_extract_all(first, F.lit(r"(\d[\d.,]*)"), F.lit(1)), tr_number)
    results = audit.groupBy("run_id").agg(F.collect_set("written").alias("written"))
    met = answers.join(results, "run_id")
    return met.select("run_id", (F.lower(first).contains("kısa cevap") & ~F.coalesce(F.arrays_overlap(said, F.col("written")), F.lit(False))).alias("missing"))


#: Cells of a table of edits up to which it is filled one by one.
SHORT = 1 << 20


def _single(c: str) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def char_error(truth: str, read: str) -> Column:
    """Edits a character. Short pairs are measured in place, where the quadratic table is small."""
    a, b = _single(truth), _single(read)
    short = F.length(a) * F.length(b).cast("long") <= SHORT
    far = char_distance(F.when(~short, a), F.when(~short, b))
    return F.when(short, F.levenshtein(F.when(short, a), F.when(short, b))).otherwise(far) / F.greatest(F.lit(1), F.length(a))


def word_error(truth: str, read: str) -> Column:
    """Edits a word."""
    a, b = _single(truth), _single(read)
    return word_distance(a, b) / F.greatest(F.lit(1), F.size(F.split(a, " ")))


def diacritic_loss(truth: str, read: str, letters: str = DIACRITICS) -> Column:
    n = lambda c, ch: F.length(c) - F.length(F.replace(F.col(c), F.lit(ch), F.lit("")))
    lost, all_ = F.lit(0), F.lit(0)
    for ch in letters:
        lost, all_ = lost + F.greatest(F.lit(0), n(truth, ch) - n(read, ch)), all_ + n(truth, ch)
    return F.when(all_ > 0, lost / all_).otherwise(0.0)


def ocr_report(rates: DataFrame) -> DataFrame:
    return rates.groupBy("kind", "variant").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("cer"), 6).alias("cer"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.median("seconds"), 6).alias("median_seconds"), F.max("seconds").alias("max_seconds"))


def answer_checks(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """(no, kind, passed): answers (no, answer) against checks (no, kind, values array<string>, pattern).

    number: one value stands in the answer as a whole number, thousands separators aside;
    any and none: one or none of the values occurs; forbidden: the pattern doesn't match;
    context: if the first value occurs, another does.
    """
    plain = F.regexp_replace("answer", r"(?<=\d)[.,](?=\d{3}(?!\d))", "")
    low = F.lower("answer")
    has = F.exists("values", lambda v: F.contains(low, F.lower(v)))
    number = F.exists("values", lambda v: F.regexp_like(plain, F.concat(F.lit(r"(?<![\d])"), v, F.lit(r"(?![\d])"))))
    met = answers.join(checks, "no")
    rest = F.exists(F.slice("values", F.lit(2), F.size("values")), lambda v: F.contains(low, F.lower(v)))
    context = ~F.contains(low, F.lower(F.col("values")[0])) | rest
    passed = F.when(F.col("kind") == "number", number).when(F.col("kind") == "any", has).when(F.col("kind") == "none", ~has).when(F.col("kind") == "forbidden", ~F.regexp_like("answer", F.col("pattern"))).otherwise(context)
    return met.select("no", "kind", passed.alias("passed"))


def eval_report(results: DataFrame) -> DataFrame:
    each = results.groupBy("no").agg(F.bool_and("passed").alias("passed"))
    return each.agg(F.count(F.lit(1)).alias("questions"), F.count_if("passed").alias("passed"))
