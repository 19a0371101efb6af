"""Text functions: column expressions, JVM-side but for the normalisation of combining marks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that extraction leaves behind and what readers type for them.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
VARIANTS, STRAIGHT = "‐‑‒–—‘’“”", "-----''\"\""
# Words that the index leaves out; scores depend on each of them.
STOP_WORDS = "ve veya ile bir bu şu o için olarak da de ki mi mı mu mü ne nedir nasıl hangi gibi daha en çok her tüm olan olup ise ya hem the a an of and or to in is".split()
# Letters and words by which a question is taken for Turkish.
MARKER_LETTERS = "çğıöşüÇĞİÖŞÜ"
MARKER_WORDS = "hakkında nedir nasıl nerede kaç mı mi mu mü ne ver anlat açıkla özetle göre için ile var yok midir bu şu hangi kadar olur belge belgede sözleşme sözleşmede madde sayfa bana söyle yaz".split()
# Soft hyphen, and the mark that a PDF reader leaves for one.
SOFT_BREAKS = "­￾"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(c: Column) -> Column:
    """Canonical composition (compatibility characters stay). Only texts with combining marks leave the JVM."""
    return F.when(c.rlike(r"\p{M}"), _nfc(F.when(c.rlike(r"\p{M}"), c))).otherwise(c)


def valid_text(c: Column) -> Column:
    return F.make_valid_utf8(c)


def fold_punctuation(c: Column) -> Column:
    for one, many in LIGATURES.items():
        c = F.replace(c, F.lit(one), F.lit(many))
    return F.translate(c, VARIANTS, STRAIGHT)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column, compose=nfc) -> Column:
    c = F.regexp_replace(valid_text(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"(?U)(\w)[{SOFT_BREAKS}][ \t]*\n?[ \t]*(\w)", "$1$2")
    c = F.translate(c, SOFT_BREAKS, "")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    c = compose(fold_punctuation(c))
    c = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"(?mdU)^[^\S\n]++|(?<!\s)[^\S\n]++$", ""))


def letters_in(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}+", ""))


def needs_ocr(c: Column, min_letters: int = 60) -> Column:
    dense = F.regexp_replace(c, r"(?U)\s+", "")
    size, letters = F.length(dense), letters_in(dense)
    broken = F.length(F.regexp_replace(dense, "[^�]+", ""))
    return F.coalesce((letters < min_letters) | (letters / size < 0.5) | (broken / size > 0.02), F.lit(True))


def pick_extraction(raw: Column, layout: Column) -> Column:
    share = F.length(layout) / F.length(raw)
    blank = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")
    return F.when(blank(raw), "layout").when(blank(layout) | layout.contains("(cid:") | (share < 0.8) | (share > 1.3), "raw").otherwise("layout")


def tr_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "İI", "iı"))


def tokenize(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case index terms: hyphens and slashes part, other signs vanish, single letters and stop words go."""
    bare = F.regexp_replace(F.translate(tr_lower(c), "-/", "  "), r"(?U)[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: (F.length(w) > 1) & ~w.isin(stop))


def title_case(c: Column) -> Column:
    """Title case of a text that is all capitals; abbreviations with inner dots stay."""

    def word(w: Column) -> Column:
        low = tr_lower(w)
        first = F.substring(low, 1, 1)
        head = F.when(first == "i", "İ").when(first == "ı", "I").otherwise(F.upper(first))
        return F.when(F.regexp_replace(w, r"\.+$", "").contains("."), w).otherwise(F.concat(head, F.substr(low, F.lit(2))))

    capital = c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")
    return F.when(capital, F.array_join(F.transform(F.split(strip(c), r"(?U)\s+"), word), " ")).otherwise(c)


def summary_fields(c: Column, default: Column) -> Column:
    """struct(title, kind, body) of a text whose first lines may be labelled."""
    text = strip(F.regexp_replace(c, r"(?m)^```\w*[ \t]*$", ""))
    title, kind = strip(F.regexp_extract(text, r"(?im)^[ \t]*başlık[ \t]*:[ \t]*(.+)$", 1)), strip(F.regexp_extract(text, r"(?im)^[ \t]*tür[ \t]*:[ \t]*(.+)$", 1))
    body = strip(F.regexp_replace(text, r"(?im)^[ \t]*(başlık|tür)[ \t]*:.*$\n?", ""))
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), default).alias("title"), F.nullif(kind, F.lit("")).alias("kind"), body.alias("body"))


def clip_title(c: Column, n: int = 60) -> Column:
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    head = F.substring(flat, 1, n)
    whole = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.when(whole == "", head).otherwise(whole), F.lit("…")))


def first_paragraph(c: Column, n: int = 320) -> Column:
    return F.substring(F.substring_index(strip(c), "\n\n", 1), 1, n)


def permille_fix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:%o|‰o)(?=\s?\d)", "‰")


def strip_blocks(c: Column) -> Column:
    """Without closed reasoning blocks; of an unclosed one only what stands before it stays, if anything."""
    closed = strip(F.regexp_replace(c, r"(?is)<(think|thinking|reasoning)\b[^>]*>.*?</\1\s*>", ""))
    before = strip(F.regexp_replace(closed, r"(?is)<(think|thinking|reasoning)\b[^>]*>.*", ""))
    return F.when(before != "", before).otherwise(F.when(closed != "", closed).otherwise(strip(c)))


def extract_json(c: Column) -> Column:
    """The first JSON object found in a text as a variant: a fenced block, the whole text, or its outermost braces."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    found = F.coalesce(*[F.try_parse_json(F.when(F.ltrim(x).rlike(r"^[\[{]"), x)) for x in (fenced, c, braces)])
    listed = F.ltrim(F.to_json(found)).startswith("[")
    return F.when(listed, F.try_parse_json(F.concat(F.lit('{"items":'), F.to_json(found), F.lit("}")))).otherwise(found)


def parse_duration(c: Column) -> Column:
    """Seconds of 30, 2.5s, 1m30s or 500ms; null for words."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(ms|s|m|h)?"
    numbers = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x.cast("double"))
    units = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), lambda u: F.when(F.lower(u) == "ms", 0.001).when(F.lower(u) == "m", 60.0).when(F.lower(u) == "h", 3600.0).otherwise(1.0))
    total = F.aggregate(F.zip_with(numbers, units, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.when((F.size(numbers) > 0) & ~F.ltrim(c).rlike(r"^\p{L}"), total)


def strip_citations(c: Column) -> Column:
    mark = r"[ \t]*+\(?+[ \t]*+(?:\[\d+\][ \t,]*+)++\)?+"  # possessive: a mark is taken whole before what follows is looked at
    out = F.regexp_replace(F.regexp_replace(c, mark + r"(?=[.,;:)!?\n]|\z)", ""), mark, " ")
    return strip(F.regexp_replace(out, r"\|\s{2,}\|", "| — |"))


def short_answer_first(c: Column, mark: str = "**Kısa cevap:**") -> Column:
    """Moves the last paragraph that begins with the mark to the front; an earlier one at the very start goes."""
    last = F.length(c) - F.length(F.substring_index(c, mark, -1)) - len(mark)  # characters before the last mark
    tail, body = strip(F.substr(c, last + 1)), strip(F.substring(c, F.lit(1), last))
    doubled = F.when(body.contains("\n\n"), strip(F.substr(body, F.instr(body, "\n\n") + 2))).otherwise("")
    body = F.when(body.startswith(mark), doubled).otherwise(body)
    moved = F.regexp_replace(strip(F.concat(tail, F.lit("\n\n"), body)), r"\s*<br\s*/?>\s*", " · ")
    return F.when(c.contains(mark) & (last > 0), moved).otherwise(c)


def token_estimate(c: Column) -> Column:
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.greatest(F.floor(F.length(c) / 4), F.floor(words * F.lit(1.3)))).cast("long")


def lang_marker(c: Column) -> Column:
    words = F.transform(F.split(c, r"(?U)\s+"), lambda w: F.lower(F.btrim(w, F.lit(".,:;?!()"))))
    return c.rlike(f"[{MARKER_LETTERS}]") | F.arrays_overlap(words, F.array(*map(F.lit, MARKER_WORDS)))


def clamp_rating(c: Column) -> Column:
    number = c.try_cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.when(~F.isnan(number), whole), F.lit(3)))).cast("int")


def page_label(section: Column, kind: Column, start: Column, end: Column) -> Column:
    pages = F.when((kind == "summary") | start.isNull(), "özet").when(start == F.coalesce(end, start), F.concat(F.lit("s. "), start)).otherwise(F.concat(F.lit("s. "), start, F.lit("-"), end))
    return F.concat_ws(" · ", F.nullif(section, F.lit("")), pages)


# What counts as a heading, a line that is none, and a page number; chunks and their sections depend on it.
ARTICLE = r"(?iuU)^\s*(madde|md\.)\s*\d+"
PART = r"(?iuU)^\s*((birinci|ikinci|üçüncü|dördüncü|beşinci|altıncı|yedinci|sekizinci|dokuzuncu|onuncu)\s+bölüm|bölüm\s+[\divxlc]+|kısım\s+[\divxlc]+)\b"
NUMBERED = r"(?U)^\s*(\d+(?:\.\d+){0,3})[.)]?\s+(\S.{1,70})$"
NO_SECTION = r"(?iuU)(tablo\s*\d|şekil\s*\d|sayfa\s*\d|http|www\.|@|©|tel:|faks|e-posta)"
PAGE_NUMBER = r"(?iuU)^\W*(sayfa|page)?\s*\d{1,4}(\s*(/|of|-)\s*\d{1,4})?\W*$"


def _digit_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{Nd}+", "")) / F.greatest(F.length(c), F.lit(1))


def heading(line: Column) -> Column:
    """The heading that a line is, with single spaces; null if it is none."""
    s = strip(line)
    words = F.split(s, r"(?U)\s+")
    flat, n = F.array_join(words, " "), F.size(words)
    rest = F.regexp_extract(s, NUMBERED, 2)
    none = F.lit(None).cast("string")
    capitals = (letters_in(s) >= 4) & s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}") & (n <= 8) & ~s.rlike("[,;/]") & (_digit_share(s) < 0.2)
    return (
        F.when((F.length(s) <= 2) | (F.length(s) >= 90) | s.rlike(NO_SECTION) | s.rlike("[,;]$"), none)
        .when(s.rlike(ARTICLE) | s.rlike(PART), flat)
        .when(n > 10, none)
        .when((rest != "") & ~s.endswith("."), F.when(rest.rlike(r"^\p{L}") & (_digit_share(rest) < 0.15), flat))
        .when(capitals, flat)
    )


def edge_key(line: Column) -> Column:
    """What a page's first and last lines are compared by: no page number, lower case; empty for lines that don't count."""
    bare = F.regexp_replace(line, r"(?iU)^\s*(sayfa|page)?\s*\d{1,4}\s+|\s+\d{1,4}\s*$", "")
    key = strip(F.regexp_replace(tr_lower(bare), r"(?U)\s+", " "))
    skip = line.rlike(ARTICLE) | line.rlike(PART) | (F.length(line) > 80) | (F.size(F.split(strip(line), r"(?U)\s+")) > 10) | (letters_in(key) < 3)
    return F.when(skip, "").otherwise(key)
