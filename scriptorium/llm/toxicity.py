"""Toxicity scores of a convolutional text classifier trained in numpy."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, cut_words, materialize

#: Rows of the embedding table, its width, filters of each width, the filter widths, and how many of a filter's highest activations are pooled.
BUCKETS, DIMS, FILTERS, WIDTHS, TOP = 1 << 18, 12, 8, (1, 2, 3), 3
PAD = max(WIDTHS)  # places of padding behind each text
PARTS = 3  # hashes of a word: whole, first four and first five letters
#: Labelled rows a model is fitted on at most, of each label, and the longest text among them.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 3000, 20_000
#: Words that tell a language, of each at most, and how much more frequent than elsewhere they are, as a logarithm.
MARKERS, LEAST_LIFT = 40, 0.7
#: Words that a worker remembers the hashes of, and places that filters pass over at a time.
CACHE_WORDS, SPAN = 200_000, 60_000


def word_rows(word: str) -> tuple[int, int, int]:
    return tuple(zlib.crc32(f"{k}:{part}".encode()) % BUCKETS for k, part in enumerate((word, word[:4], word[:5])))


_ROWS: dict[str, tuple[int, int, int]] = {}


def _rows_of(words: list[str]) -> np.ndarray:
    if len(_ROWS) > CACHE_WORDS:
        _ROWS.clear()
    known = [_ROWS.get(w) or _ROWS.setdefault(w, word_rows(w)) for w in words]
    return np.array(known, np.int64).reshape(-1, PARTS)


@dataclass
class Words:
    """Texts as places of their distinct words; word 0 is padding and ends every text."""

    words: list[str]
    rows: np.ndarray  # (distinct words, PARTS) rows of the embedding table
    at: np.ndarray  # word of each place
    starts: np.ndarray  # first place of each text, and the end of the last
    text: np.ndarray  # text of each place

    def of(self, texts: np.ndarray) -> Words:
        """Some of the texts, with the words that they hold."""
        sizes = self.starts[texts + 1] - self.starts[texts]
        ends = np.cumsum(sizes)
        at = self.at[np.arange(ends[-1]) + np.repeat(self.starts[texts] - (ends - sizes), sizes)]
        held, at = np.unique(np.r_[0, at], return_inverse=True)
        return Words([], self.rows[held], at[1:], np.r_[0, ends], np.repeat(np.arange(len(texts)), sizes))


def read(texts: list[str | None]) -> Words:
    words, lengths = cut_words(texts)
    words = words.filter(pc.not_equal(words, "\0")).dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    own = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.r_[0, np.cumsum(lengths + PAD)]
    at = np.zeros(starts[-1], np.int32)
    at[np.arange(len(own)) + PAD * own] = words.indices.to_numpy(zero_copy_only=False) + 1
    return Words(["", *distinct], np.concatenate([np.zeros((1, PARTS), np.int64), _rows_of(distinct)]), at, starts, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + PAD))


@dataclass
class Model:
    table: np.ndarray  # (BUCKETS, DIMS)
    filters: np.ndarray  # (DIMS, all filters' taps): FILTERS columns for each tap of each width
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (TOP * len(WIDTHS) * FILTERS,): for the highest activation of each filter, then for the second ones and so on
    out_bias: float
    languages: int = 0
    markers: dict[str, list[tuple[int, float]]] = field(default_factory=dict)  # words that speak for languages, and how much
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))  # logit above which a text of a language is toxic; the last for texts of none

    def embed(self, rows: np.ndarray) -> np.ndarray:
        x = self.table[rows].sum(axis=1)
        x[0] = 0.0
        return x

    def maps(self, taps: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Activations of every filter at every place; a width's taps add up."""
        padded, out, column = np.r_[at, np.zeros(PAD, np.int64)], [], 0
        for width in WIDTHS:
            total = np.zeros((len(at), FILTERS), taps.dtype)
            for tap in range(width):
                total += taps[:, column : column + FILTERS][padded[tap : tap + len(at)]]
                column += FILTERS
            out.append(total)
        found = np.concatenate(out, axis=1) + self.bias
        found[at == 0] = -1e9  # a window starts at a word
        return found

    def logits(self, words: Words) -> np.ndarray:
        taps, found, first = self.embed(words.rows) @ self.filters, [], 0
        n = len(words.starts) - 1
        while first < n:  # some texts at a time; a long text in stretches, so that memory follows neither
            last = max(first + 1, int(np.searchsorted(words.starts, words.starts[first] + SPAN, "right")) - 1)
            begin, end = int(words.starts[first]), int(words.starts[last])
            pooled = np.full((TOP, last - first, len(self.bias)), -1e9, taps.dtype)
            for a in range(begin, end, SPAN):
                b = min(end, a + SPAN)
                maps = self.maps(taps, words.at[a : min(end, b + PAD)])[: b - a]
                if last - first == 1:
                    pooled = np.sort(np.concatenate([pooled, pool(maps, np.zeros(1, np.int64))[0]]), axis=0)[: -TOP - 1 : -1]
                else:
                    pooled = pool(maps, words.starts[first:last] - begin)[0]
            found.append(np.maximum(pooled, 0.0).transpose(1, 0, 2).reshape(last - first, -1) @ self.out + self.out_bias)
            first = last
        return np.concatenate(found) if found else np.empty(0)

    def language_of(self, words: Words) -> np.ndarray:
        """The language that most speaks for, `languages` where nothing does."""
        votes = np.zeros((len(words.words), max(1, self.languages)))
        for i, w in enumerate(words.words):
            for k, weight in self.markers.get(w, ()):
                votes[i, k] = weight
        telling = np.flatnonzero(votes.any(axis=1)[words.at])
        sums = np.zeros((len(words.starts) - 1, votes.shape[1]))
        np.add.at(sums, words.text[telling], votes[words.at[telling]])
        return np.where(sums.any(axis=1), sums.argmax(axis=1), self.languages)


def pool(maps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(TOP highest activations of each text and filter, their places). Below zero only the highest counts, as none of them is used."""
    maps, n = maps.copy(), maps.shape[1]
    text = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(maps)]))
    peaks, places = np.full((TOP, len(starts), n), -1e9, maps.dtype), np.zeros((TOP, len(starts), n), np.int64)
    places[:] = starts[None, :, None]
    for k in range(TOP):
        peaks[k] = np.maximum.reduceat(maps, starts, axis=0)
        row, column = np.nonzero((maps == peaks[k][text]) & (maps > 0))
        cell, one = np.unique(text[row] * n + column, return_index=True)
        places[k, cell // n, cell % n] = row[one]
        maps[row[one], column[one]] = -1e9
    return peaks, places


CUT = 0.7
#: Steps of a histogram of logits: width and outermost number.
STEP, OUTERMOST = 1 / 64, 2560
#: Spread of untrained embeddings, scale of what word counts say of labels, gradient steps, texts of a step, and steps of the two optimizers.
NOISE, ODDS, STEPS, BATCH, RATE, TABLE_RATE = 0.02, 0.2, 100, 64, 0.01, 0.02


def untrained() -> Model:
    n = len(WIDTHS) * FILTERS
    return Model(np.zeros((BUCKETS, DIMS), np.float32), np.zeros((DIMS, sum(WIDTHS) * FILTERS), np.float32), np.zeros(n, np.float32), np.zeros(TOP * n, np.float32), -4.0)


class _Adam:
    def __init__(self, *shapes: tuple[int, ...]):
        self.m, self.v, self.t = [np.zeros(s, np.float32) for s in shapes], [np.zeros(s, np.float32) for s in shapes], 0

    def steps(self, grads: list[np.ndarray], rate: float) -> list[np.ndarray]:
        self.t += 1
        out = []
        for m, v, g in zip(self.m, self.v, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            out.append(rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8))
        return out


def told_by_counts(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signed root of the likelihood ratio that a bucket of words is independent of the label, whether two texts hold it) by bucket."""
    n, z, seen = np.array([(labels == 0).sum(), (labels == 1).sum()], float), np.zeros(BUCKETS), np.zeros(BUCKETS, bool)
    place = np.flatnonzero(words.at > 0)
    for part in range(PARTS):
        pairs, times = np.unique(words.text[place].astype(np.int64) * BUCKETS + words.rows[words.at[place], part], return_counts=True)
        for least in (1, 2):  # texts that hold it, and texts that hold it twice
            both = pairs[times >= least]
            held = np.stack([np.bincount(both[labels[both // BUCKETS] == y] % BUCKETS, minlength=BUCKETS) for y in (0, 1)]).astype(float)
            seen |= held.sum(axis=0) > 1
            share = held.sum(axis=0) / n.sum()
            ratio = np.zeros(BUCKETS)
            for y in (0, 1):
                for count, expected in ((held[y], n[y] * share), (n[y] - held[y], n[y] * (1 - share))):
                    ratio += 2 * np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
            signed = np.sign(held[1] / n[1] - held[0] / n[0]) * np.sqrt(np.maximum(ratio, 0.0))
            z = np.where(np.abs(signed) > np.abs(z), signed, z)
    return z, seen


def gradients(model: Model, words: Words, labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray]:
    """(loss, gradients of filters, bias, out and out_bias, words touched, gradients of their embeddings): weighted mean cross entropy."""
    x = model.embed(words.rows)
    a = model.maps(x @ model.filters, words.at)
    peaks, best = pool(a, words.starts[:-1])
    h = np.maximum(peaks, 0.0).transpose(1, 0, 2).reshape(len(labels), -1)
    logit = np.clip(h @ model.out + model.out_bias, -30, 30)
    p = 1.0 / (1.0 + np.exp(-logit))
    loss = float((weight * (np.logaddexp(0.0, logit) - labels * logit)).mean())
    g = ((p - labels) * weight / len(labels)).astype(model.out.dtype)
    d = g[None, :, None] * model.out.reshape(TOP, 1, -1) * (peaks > 0)
    taps = np.zeros((len(x), model.filters.shape[1]), x.dtype)
    padded, column = np.r_[words.at, np.zeros(PAD, np.int64)], 0
    for k, width in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        for tap in range(width):
            np.add.at(taps, (padded[best[:, :, own] + tap], np.arange(column, column + FILTERS)[None, None, :]), d[:, :, own])
            column += FILTERS
    touched = np.flatnonzero(taps.any(axis=1))
    touched = touched[touched > 0]
    return loss, [x[touched].T @ taps[touched], d.sum(axis=(0, 1)), h.T @ g, g.sum()], touched, taps[touched] @ model.filters.T


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7, langs: list[str | None] | None = None) -> tuple[Model, np.ndarray]:
    """(a model of texts and 0/1 labels, positions of those it is fitted on). A fifth is left for the thresholds, which aren't set; without both labels, untrained.

    The first coordinate of an embedding starts from what counts of the word's buckets say of
    the label, and the first filter reads it; buckets that one text alone holds stay at zero, so
    that a text can't be told by words of its own.
    """
    labels = np.asarray(labels, np.float32)
    rng = np.random.default_rng(seed)
    used = np.sort(rng.permutation(len(texts))[len(texts) // 5 :])
    if len(set(labels[used].tolist())) < 2:
        return untrained(), np.zeros(0, np.int64)
    whole, labels = read([texts[i] for i in used]), labels[used]
    _ROWS.clear()
    model = untrained()
    model.languages, model.markers = language_markers(whole, [langs[i] for i in used.tolist()] if langs else [])
    model.thresholds = np.zeros(model.languages + 1)
    whole.words = []
    z, alive = told_by_counts(whole, labels)
    model.table = (rng.normal(0, NOISE, model.table.shape) * alive[:, None]).astype(np.float32)
    model.table[:, 0] += np.where(alive, ODDS * z, 0.0)
    model.filters = rng.normal(0, 0.3, model.filters.shape).astype(np.float32)
    model.filters[:, 0] = 0.0
    model.filters[0, 0] = 1.0
    model.out = rng.normal(0, 0.1, model.out.shape).astype(np.float32)
    model.out[:: len(model.bias)] = 0.5
    model.out_bias = -2.0
    dense = _Adam(model.filters.shape, model.bias.shape, model.out.shape, ())
    square = np.full((BUCKETS, 1), 1e-6, np.float32)
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(steps):
        some = rng.choice(len(used), min(BATCH, len(used)), replace=False)
        words = whole.of(some)
        _, grads, touched, x_grad = gradients(model, words, labels[some], weight[some])
        moves = dense.steps(grads, RATE)
        model.filters -= moves[0]
        model.bias -= moves[1]
        model.out -= moves[2]
        model.out_bias -= float(moves[3])
        for part in range(PARTS):  # Adagrad on the rows that were met
            rows = words.rows[touched, part]
            live = alive[rows]
            np.add.at(square, rows[live], (x_grad[live] ** 2).mean(axis=1, keepdims=True))
            np.add.at(model.table, rows[live], -TABLE_RATE * x_grad[live] / np.sqrt(square[rows[live]]))
    return model, used


def language_markers(words: Words, langs: list[str | None]) -> tuple[int, dict[str, list[tuple[int, float]]]]:
    """(languages, words that speak for each): frequent words that texts of other languages lack, weighed by how much more frequent they are."""
    names = sorted({x for x in langs if x is not None})
    if not names:
        return 0, {}
    own, wide = np.array([names.index(x) if x is not None else -1 for x in langs]), len(words.words)
    place = np.flatnonzero((words.at > 0) & (own[words.text] >= 0))
    pairs = np.unique(words.text[place].astype(np.int64) * wide + words.at[place])  # each word once a text
    held = np.stack([np.bincount(pairs[own[pairs // wide] == k] % wide, minlength=wide) for k in range(len(names))])
    total, out = held.sum(axis=0), {}
    for k in range(len(names)):
        n, rest = int((own == k).sum()), int(((own >= 0) & (own != k)).sum())
        lift = np.log((held[k] + 0.5) / (n + 1)) - np.log((total - held[k] + 0.5) / (rest + 1))
        some = np.flatnonzero((held[k] > 0.05 * n) & (lift > LEAST_LIFT))
        for i in sorted(some.tolist(), key=lambda i: (-held[k][i] * lift[i], words.words[i]))[:MARKERS]:
            out.setdefault(words.words[i], []).append((k, float(lift[i])))
    return len(names), out


def _threshold(steps: np.ndarray, clean: np.ndarray, toxic: np.ndarray, weight: float = 1.0) -> float:
    """Middle of the cuts with the least errors, steps ascending. An error on a clean text weighs 1, a toxic one `weight`."""
    if not clean.sum() + toxic.sum():
        return 0.0
    errors = weight * np.r_[0, np.cumsum(toxic)] + np.r_[np.cumsum(clean[::-1])[::-1], 0]
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    cut = best[len(best) // 2]
    return float((steps[max(0, cut - 1)] + steps[min(len(steps) - 1, cut)]) / 2 * STEP)


def _thresholds(sums: list[tuple[int, int, int, int]], clean_rows: int, toxic_rows: int, languages: int) -> np.ndarray:
    """Thresholds of each language from (language, step, clean, toxic); few texts lean to the general one.

    clean_rows, toxic_rows: labels of each kind before any were fitted on. Errors weigh so that
    both kinds count by these, and an error on a clean text the more, the rarer toxic ones are.
    """
    clean_left, toxic_left = sum(r[2] for r in sums), sum(r[3] for r in sums)
    weight = toxic_rows / max(1, toxic_left) * max(1, clean_left) / max(1, clean_rows)

    def of(rows: list[tuple[int, int, int, int]]) -> tuple[float, int]:
        steps, at = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)
        clean, toxic = (np.zeros(len(steps), np.int64) for _ in range(2))
        np.add.at(clean, at, [r[2] for r in rows])
        np.add.at(toxic, at, [r[3] for r in rows])
        return _threshold(steps, clean, toxic, weight), int(min(clean.sum(), toxic.sum()))

    if not sums:
        return np.zeros(languages + 1)
    general, found = of(sums)[0], []
    for k in range(languages + 1):
        own = [r for r in sums if r[0] == k]
        cut, n = of(own) if own else (general, 0)
        found.append((n * cut + 20 * general) / (n + 20))
    return np.array(found)


def for_training(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """(a model without thresholds, labels (doc_id, toxic) that may set them, all labels) of docs (doc_id, text, and lang if there is one) and labels (doc_id, toxic 0/1).

    Fitted on at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled ids, the first by a hash of the
    id, with texts up to SAMPLE_CHARS, of rows that repeat an id the least text; all other
    labelled rows, and a fifth of these, set the thresholds. The words that tell a text's
    language are learnt from the same rows; without a lang column there is one threshold.
    allowed: a condition on doc_id. Rows with a null id or another label don't count; an id
    with both labels counts as toxic.
    """
    spark = docs.sparkSession
    marked = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = (marked.where(allowed) if allowed is not None else marked).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = materialize(marked, "labels")
    rank = F.xxhash64("doc_id")
    some = marked.where("toxic = 1").orderBy(rank).limit(SAMPLE_TOXIC).unionByName(marked.where("toxic = 0").orderBy(rank).limit(SAMPLE_CLEAN))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", lang.alias("lang")).where(F.char_length("text") <= SAMPLE_CHARS)
    one = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    rows = sorted((r.doc_id, r.t.text, r.t.lang, r.toxic) for r in one.collect())  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    ids, texts, langs, toxic = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
    del rows
    model, used = fit(texts, np.array(toxic), langs=langs)
    fitted = spark.createDataFrame(pd.DataFrame({"doc_id": np.array(sorted({ids[i] for i in used.tolist()}), np.int64)}), "doc_id long")
    return model, marked.join(F.broadcast(fitted), "doc_id", "left_anti"), marked


def judge(spark: SparkSession, model: Model):
    """A column function: text to struct(logit, language)."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            some, parts = texts.tolist(), []
            for at in range(0, len(some), 1000):
                words = read(some[at : at + 1000])
                parts.append(pd.DataFrame({"logit": shared.value.logits(words).astype(np.float64), "language": shared.value.language_of(words).astype(np.int32)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"logit": np.zeros(0), "language": np.zeros(0, np.int32)})

    return F.pandas_udf(run, "logit double, language int")


def calibrated(judged: DataFrame, left: DataFrame, labels: DataFrame, model: Model) -> Model:
    """The model with thresholds from all rows of judged (doc_id, logit, language) that left (doc_id, toxic) labels.

    Histograms of logits by language and label are summed on Spark; no text moves, and what is
    collected is bounded by their steps. labels: all that the model may learn from.
    """
    step = F.greatest(F.lit(-OUTERMOST), F.least(F.lit(OUTERMOST), F.rint(F.col("logit") / STEP).cast("long"))).alias("step")
    met = judged.select("doc_id", step, "language").join(left, "doc_id")
    sums = met.groupBy("language", "step").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    labelled = labels.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    model.thresholds = _thresholds([tuple(r) for r in sums.collect()], *labelled, model.languages)
    return model


def scored(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(row, score): the columns `keep` of docs (doc_id, text and others; all, if none are named) as a struct, and the score of the text, 0 to 1.

    Each text is judged once, where it is read; thresholds follow from narrow rows, and a text at its language's threshold scores CUT.
    """
    spark = docs.sparkSession
    model, left, marked = train(docs, labels, allowed)
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if keep is None else keep)])
    judged = docs.select(row.alias("row"), F.col("doc_id").alias("id"), judge(spark, model)("text").alias("j"))
    with arrow_limits(spark):
        judged = materialize(judged.select("row", "id", F.col("j.logit").alias("logit"), F.col("j.language").alias("language")), "judged")
    model = calibrated(judged.select(F.col("id").alias("doc_id"), "logit", "language"), left, marked, model)
    threshold = F.element_at(F.array(*map(F.lit, model.thresholds.tolist())), F.col("language") + 1)
    shifted = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") - threshold + math.log(CUT / (1 - CUT))))
    return judged.select("row", (1 / (1 + F.exp(-shifted))).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> DataFrame:
    """The rows of docs that the classifier doesn't reject. See toxicity()."""
    return scored(docs, labels, allowed).where(F.col("score") < CUT).select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs.

    Labels are learnt from rows whose crc32(id) mod 3 is not 1; the others are held out. The
    score reads the text only: its language, which chooses the calibrated threshold, is told
    from its own words. A null or empty text has the score of no words. Without labels of both
    kinds every score is low. A null id counts as not held out. An empty table gives no rows;
    rows that repeat an id all stay. A column lang, if there is one, tells the fit which words
    go with which language; other columns are not read.
    """
    lang = [F.col("lang")] if "lang" in docs.columns else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *lang)
    held = F.coalesce(F.pmod(F.crc32(F.col("row.doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    out = scored(docs, labels, for_training(F.col("doc_id")), ["doc_id"])
    return out.select(F.col("row.doc_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
