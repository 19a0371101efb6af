"""Language identification of pages by fusing evidence from text, markup and address."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize
from .markup import CONTENT, END, START, TEXT, Scanner
from .urls import host_of

#: Buckets of letter trigrams, labelled texts a language is learnt from at most, and the longest of them.
BUCKETS, SAMPLE, SAMPLE_CHARS = 1 << 14, 1500, 50_000
#: Share of a trigram's information that counts (neighbours overlap), and what a text can say at most, in nats.
TEMPER, MOST_NATS = 0.2, 30.0
#: Rows that a prior counts for at each level, and those that a confusion table starts from.
STRENGTH, PSEUDO = 10.0, 1.0
#: Elements whose text nobody reads (fixed values).
UNREAD = frozenset("script style template noscript iframe noembed noframes".split())
_CODE = re.compile(r"[A-Za-z]{2,3}(?![A-Za-z])")


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of the letters of a text, lower-cased, words parted by one space."""
    raw = np.frombuffer((" " + re.sub(r"[\W\d_]+", " ", (text or "").lower()) + " ").encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(BUCKETS, np.int64)
    code = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)


def read_page(source: str | None) -> tuple[str, str | None]:
    """(text, declared language) of a page: what stands between its tags, and the first language that an html or meta tag names."""
    parts, declared, skip = [], None, ""
    for kind, name, attrs in Scanner(source or "").tokens():
        if kind in (TEXT, CONTENT):
            if not skip:
                parts.append(name)
            continue
        parts.append(" ")
        if kind == START and not skip:
            if name in UNREAD:
                skip = name
            elif declared is None and name == "html":
                declared = attrs.get("lang", "")
            elif declared is None and name == "meta" and attrs.get("http-equiv", attrs.get("name", "")).lower() == "content-language":
                declared = attrs.get("content", "")
            code = _CODE.match((declared or "").strip())
            declared = code[0].lower() if code else None
        elif kind == END and name == skip:
            skip = ""
    return html.unescape("".join(parts)), declared


#: Languages that have a class of their own, and the name of the class of all others.
MOST_LANGUAGES, OTHER = 255, "other"


def plain_text(source: str | None) -> str:
    return read_page(source)[0]


def declared_of(source: str | None) -> str | None:
    return read_page(source)[1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + trigram_counts(text)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": n[at].astype(np.int64)})


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of trigrams by language) of docs (text, lang).

    Learnt from at most SAMPLE different texts a language, the first by a hash, of up to
    SAMPLE_CHARS.
    Languages are the MOST_LANGUAGES that docs names most often; where it names more, all the
    others are one class, OTHER, so that the tables stay bounded.
    """
    rows = docs.select("lang", "text").where("lang IS NOT NULL")
    named = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    languages = sorted({r.lang for r in named[:MOST_LANGUAGES]} | ({OTHER} if len(named) > MOST_LANGUAGES else set()))
    if len(named) > MOST_LANGUAGES:
        rows = rows.withColumn("lang", F.when(F.col("lang").isin(languages), F.col("lang")).otherwise(OTHER))
    short = rows.where(F.char_length("text") <= SAMPLE_CHARS).withColumn("h", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("h")  # only hashes are ordered, and each task keeps its first of a language
    last = short.select("lang", "h").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE).groupBy("lang").agg(F.max("h").alias("last"))
    some = short.join(F.broadcast(last), "lang").where("h <= last").groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")  # a row a language
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in some.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[languages.index(r.lang), r.bucket] += r.n
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        mean = logs.mean(axis=0)
        for batch in batches:
            pages = [read_page(x) for x in batch.column(1).to_pylist()]
            nats = np.stack([(logs - mean) @ trigram_counts(text) for text, _ in pages]) * TEMPER
            nats -= nats.max(axis=1, keepdims=True)
            nats = np.maximum(nats, -MOST_NATS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([declared for _, declared in pages], pa.string()), pa.array(nats.tolist(), pa.list_(pa.float64())), pa.array([any(c != 0.0 for c in x) for x in nats.tolist()], pa.bool_())],
                names=["page_id", "url", "declared", "nats", "told"],
            )

    return run



def _tallies(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, tally): texts of each language that the text alone tells, by key; summed map-side first."""
    sums = [F.count_if((F.col("guess") == i) & F.col("told")).cast("double") for i in range(n)]
    return rows.groupBy(key).agg(F.array(*sums).alias("tally"))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, declared, suffix, host, text_lang, lang, confidence) of every page.

    lang has the highest posterior: the text's tempered trigram likelihood, the likelihood of
    the declared language and of the address suffix (from how often each goes with what the
    texts say), and the host's prior, smoothed towards its suffix's and that towards all
    pages'. All counts are grouped sums over all pages; a page doesn't vote for itself. A page
    without text, markup or address falls back on the prior; null values are such. Without a
    labelled text, lang is null; beyond MOST_LANGUAGES languages, the rest are one class. Rows that repeat an id all stay; an empty table gives no rows.
    """
    spark = pages.sparkSession
    languages, logs = train(docs)
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return pages.select(F.col(id_col), none.alias("declared"), none.alias("suffix"), none.alias("host"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    shared = spark.sparkContext.broadcast(logs)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"), F.col(url_col).alias("url"))
    read = arrow_batches(rows, _read(shared), "page_id long, url string, declared string, nats array<double>, told boolean", rows=500)
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    read = read.withColumn("host", host).withColumn("suffix", F.substring_index(F.regexp_replace("host", ":[0-9]*$", ""), ".", -1))
    read = read.withColumn("declared", F.coalesce("declared", F.lit(""))).withColumn("guess", F.array_position("nats", F.array_max("nats")).cast("int") - 1)
    seen = materialize(read.drop("url"), "evidence")
    by_host = _tallies(seen, "host", n).withColumnRenamed("tally", "host_tally")
    by_suffix = _tallies(seen, "suffix", n).withColumnRenamed("tally", "suffix_tally")
    by_declared = _tallies(seen, "declared", n).withColumnRenamed("tally", "declared_tally")
    whole = seen.agg(F.array(*[F.count_if((F.col("guess") == i) & F.col("told")).cast("double") for i in range(n)])).first()[0]
    met = seen.join(materialize(by_declared, "declared-tallies"), "declared").join(materialize(by_suffix, "suffix-tallies"), "suffix")
    met = met.join(materialize(by_host, "host-tallies"), "host")  # read anew, so that a hot host's rows can be split over tasks
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i == F.col("guess")) & F.col("told"), 1.0).otherwise(0.0))
    met = met.withColumn("own", own).withColumn("whole", F.array(*[F.lit(float(x)) for x in whole]))
    for name in ("host_tally", "suffix_tally", "declared_tally", "whole"):
        met = met.withColumn(name, F.zip_with(name, "own", lambda a, b: a - b))
    met = met.withColumns({f"{x}_sum": F.aggregate(x, F.lit(0.0), lambda a, b: a + b) for x in ("host_tally", "suffix_tally", "declared_tally", "whole")})

    def posterior(i: Column) -> Column:
        base = (F.col("whole")[i] + PSEUDO) / (F.col("whole_sum") + PSEUDO * n)
        suffix = (F.col("suffix_tally")[i] + STRENGTH * base) / (F.col("suffix_tally_sum") + STRENGTH)
        prior = (F.col("host_tally")[i] + STRENGTH * suffix) / (F.col("host_tally_sum") + STRENGTH)
        # p(mark | language) is p(language | mark) p(mark) / p(language); p(mark) is the same for all
        said = ((F.col("declared_tally")[i] + PSEUDO * base) / (F.col("declared_tally_sum") + PSEUDO)) / base
        lean = suffix / base
        return F.col("nats")[i] + F.log(prior) + F.when(F.col("declared") != "", F.log(said)).otherwise(0.0) + F.when(F.col("suffix") != "", F.log(lean)).otherwise(0.0)

    fused = met.withColumn("post", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), posterior)).withColumn("top", F.array_max("post"))
    names = F.array(*map(F.lit, languages))
    share = 1.0 / F.aggregate(F.transform("post", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return fused.select(
        F.col("page_id").alias(id_col), blank("declared"), blank("suffix"), blank("host"), F.when(F.col("told"), names[F.col("guess")]).alias("text_lang"),
        names[F.array_position("post", F.col("top")).cast("int") - 1].alias("lang"), share.alias("confidence"),
    )
