"""Benchmark decontamination: rare n-grams find the passages that may hold an item, bounds spare most chance meetings, Smith-Waterman alignment scores the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut_words, materialize, words_of

#: Words of an item from which on it makes a document a contaminated one; pairs with shorter ones are told, but are no reason to drop a document.
LEAST_WORDS = 4
#: Words of benchmark items that one pass over the corpus looks for.
PASS_WORDS = 1_000_000
#: Words of an item beyond which its pieces of as many words are looked for one by one.
PIECE_WORDS = 10_000
MATCH, MISMATCH, GAP = 2, 1, 1
LEAST_SCORE = 0.5
#: Words between those of an n-gram, in the item and in the text, at most: two words with none or one left out between them.
SKIPS = (1, 2)


@dataclass
class Watch:
    """Some benchmark items, their n-grams, and those of them that are looked for.

    2 * matches - edits of an alignment is at least 2 * least * words of the item. So it has
    enough matched words (need) within a stretch (span), and at least `pairs` neighbouring
    matched words with one edit or none between them: n-grams of two words that skip none or
    one. An item can therefore do without its most frequent ones, as long as fewer than `pairs`
    of the places where they begin go, and still no passage that reaches the score is lost.
    """

    items: np.ndarray
    texts: list[str]
    vocabulary: list[str]
    words: np.ndarray
    starts: np.ndarray
    need: np.ndarray
    span: np.ndarray
    pairs: np.ndarray
    keys: np.ndarray  # of all n-grams, each once, rising
    first: np.ndarray  # words that an n-gram looked for begins with
    wanted: np.ndarray  # n-grams that are looked for
    owned: np.ndarray  # items of n-gram k: owners[owned[k] : owned[k + 1]]
    owners: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str]], least: float = LEAST_SCORE) -> Watch:
        cut = [words_of(t) for _, t in items]
        numbers: dict[str, int] = {}
        for words in cut:
            for w in words:
                numbers.setdefault(w, len(numbers))
        lengths = np.array([len(words) for words in cut], np.int64)
        words = np.fromiter((numbers[w] for own in cut for w in own), np.int64, int(lengths.sum()))
        watch = cls(
            np.array([i for i, _ in items], np.int64), [t for _, t in items], list(numbers), words, np.r_[0, np.cumsum(lengths)], np.ceil(least * lengths - 1e-9).astype(np.int64),
            np.maximum(1, np.floor((3 - 2 * least) * lengths + 1e-9).astype(np.int64)), np.maximum(1, np.ceil(least * lengths - 1 - 1e-9).astype(np.int64)), *[np.zeros(0, np.int64)] * 5,
        )
        watch.keys = np.unique(watch._grams()[0])
        return watch.rarest(None)

    def _grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, items, places in `words`) of all n-grams."""
        item = np.repeat(np.arange(len(self.items)), np.diff(self.starts))
        keys, owners, places = [], [], []
        for d in SKIPS:
            at = np.flatnonzero(item[d:] == item[:-d])
            keys.append(self.words[at] * len(self.vocabulary) + self.words[at + d])
            owners.append(item[at])
            places.append(at)
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(places)

    def rarest(self, counts: np.ndarray | None) -> Watch:
        """Looks for the rarest n-grams only, by counts of `keys`; without counts for all."""
        keys, owners, places = self._grams()
        number = np.searchsorted(self.keys, keys)
        worst = np.zeros(len(self.words), np.int64)
        if counts is not None:
            np.maximum.at(worst, places, counts[number])
        item = np.repeat(np.arange(len(self.items)), np.diff(self.starts))
        order = np.lexsort((np.arange(len(item)), -worst, item))  # of each item, the most frequent first
        rank = np.arange(len(item)) - self.starts[item[order]]
        kept = np.ones(len(item), bool)
        kept[order] = rank >= self.pairs[item[order]] - 1
        if counts is None:
            kept[:] = True
        use = kept[places]
        both = np.unique(np.stack([number[use], owners[use]]), axis=1)
        self.wanted = np.unique(both[0])
        self.owners = both[1]
        self.owned = np.searchsorted(both[0], np.r_[self.wanted, len(self.keys)])
        self.first = np.zeros(len(self.vocabulary) + 1, bool)
        self.first[self.keys[self.wanted] // max(1, len(self.vocabulary))] = True
        return self

    def hits(self, ids: np.ndarray, text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers in `keys`) of the n-grams in words numbered by the vocabulary, -1 for others; text: which text a word is of."""
        places, found = [], []
        for d in SKIPS:
            at = np.flatnonzero((ids[:-d] >= 0) & (ids[d:] >= 0) & (text[:-d] == text[d:]) & self.first[ids[:-d]])
            key = ids[at] * len(self.vocabulary) + ids[at + d]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            places.append(at[hit])
            found.append(place[hit])
        return np.concatenate(places), np.concatenate(found)

    def passages(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first, end): stretches in which an n-gram looked for lets an item be, at most four spans long and such that each alignment lies in one."""
        text = np.repeat(np.arange(len(lengths)), lengths)
        begin = np.r_[0, np.cumsum(lengths)]
        if not len(self.wanted) or not len(ids):
            return
        place, key = self.hits(ids, text, self.keys[self.wanted])
        many = self.owned[key + 1] - self.owned[key]
        item = self.owners[np.repeat(self.owned[key] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        place = np.repeat(place, many)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        low, high = np.maximum(begin[text[place]], place - self.span[item]), np.minimum(begin[text[place] + 1], place + self.span[item] + max(SKIPS))
        new = np.r_[True, (item[1:] != item[:-1]) | (low[1:] > high[:-1]) | (text[place[1:]] != text[place[:-1]])] if len(item) else np.zeros(0, bool)
        run = np.flatnonzero(new)
        for own, t, a, b in zip(item[run].tolist(), text[place[run]].tolist(), low[run].tolist(), np.maximum.reduceat(high, run).tolist() if len(run) else [], strict=True):
            span = int(self.span[own])
            while b - a > 4 * span:
                yield t, own, a, a + 2 * span
                a += span
            yield t, own, a, b

    def may_reach(self, item: int, ids: np.ndarray) -> int:
        """How many n-grams a stretch of `span` words shares with the item, 0 if no stretch has enough of them or of the item's words."""
        own = self.words[self.starts[item] : self.starts[item + 1]]
        if np.isin(ids, own).sum() < self.need[item]:
            return 0
        grams = np.unique(np.concatenate([own[:-d] * len(self.vocabulary) + own[d:] for d in SKIPS]))
        begins = np.zeros(len(ids) + 1, np.int64)
        for d in SKIPS:
            at = np.flatnonzero((ids[:-d] >= 0) & (ids[d:] >= 0))
            key = ids[at] * len(self.vocabulary) + ids[at + d]
            begins[at[grams[np.minimum(np.searchsorted(grams, key), len(grams) - 1)] == key]] = 1
        sums = np.r_[0, np.cumsum(begins)]
        width = min(int(self.span[item]), len(begins))
        seeds = int((sums[width:] - sums[:-width]).max())
        return seeds if seeds >= self.pairs[item] and self.reaches(item, ids) else 0

    def reaches(self, item: int, ids: np.ndarray) -> bool:
        """Whether some stretch of `span` words holds `need` of the item's words, none more often than the item does."""
        own, times = np.unique(self.words[self.starts[item] : self.starts[item + 1]], return_counts=True)
        place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        at = np.flatnonzero(own[place] == ids)
        if len(at) < self.need[item]:
            return False
        at = at[np.argsort(place[at], kind="stable")]
        word = place[at]
        before = np.arange(len(at)) - times[word]  # with this one inside, a stretch holds the word too often
        full = (before >= 0) & (word[np.maximum(before, 0)] == word)
        first = np.maximum(np.where(full, at[np.maximum(before, 0)] + 1, 0), at - self.span[item] + 1)
        change = np.bincount(np.maximum(first, 0), minlength=len(ids) + 1) - np.bincount(at + 1, minlength=len(ids) + 1)
        return bool(np.cumsum(change).max() >= self.need[item])


class Whole:
    """Items of so few words that a part of one reaches the score; they count only where they stand word for word.

    A trie of their words, a level a word: an edge is its node above and its word in one number,
    and a node is the place of its edge among those of its level. All places of a batch go down
    the levels at once.
    """

    def __init__(self, items: list[tuple[int, str]]):
        cut = [(i, words_of(t)) for i, t in items]
        numbers: dict[str, int] = {}
        for _, words in cut:
            for w in words:
                numbers.setdefault(w, len(numbers))
        self.vocabulary = list(numbers)
        self.edges: list[np.ndarray] = []
        self.items: list[np.ndarray] = []  # of each node of a level, the item that ends there, or -1
        alive = [(i, [numbers[w] for w in words], 0) for i, words in cut if words]
        while alive:
            level = len(self.edges)
            keys = np.array([node * len(numbers) + words[level] for _, words, node in alive], np.int64)
            edges = np.unique(keys)
            nodes = np.searchsorted(edges, keys).tolist()
            ends = np.full(len(edges), -1, np.int64)
            for (i, words, _), node in zip(alive, nodes, strict=True):
                if len(words) == level + 1:
                    ends[node] = i
            self.edges.append(edges)
            self.items.append(ends)
            alive = [(i, words, node) for (i, words, _), node in zip(alive, nodes, strict=True) if len(words) > level + 1]

    def places(self, ids: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(places, items, words) of the items in words numbered by the vocabulary, -1 for others; text: which text a word is of."""
        at, node = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for level, (edges, ends) in enumerate(zip(self.edges, self.items, strict=True)):
            inside = at + level < len(ids)
            at, node = at[inside], node[inside]
            own = (text[at] == text[at + level]) & (ids[at + level] >= 0)
            at, node = at[own], node[own]
            key = node * len(self.vocabulary) + ids[at + level]
            node = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
            met = edges[node] == key
            at, node = at[met], node[met]
            end = ends[node] >= 0
            yield at[end], ends[node[end]], level + 1


def align_numbers(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, first, end) of the best local alignment of two rows of numbers; memory follows the second only."""
    n = len(b)
    drift, wide = GAP * np.arange(n + 1), n + 2
    here = np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), here
    best = (0, 0, 0)
    for w in a.tolist():
        across = score[:-1] + np.where(b == w, MATCH, -MISMATCH)
        up = score[1:] - GAP
        now = np.r_[0, np.maximum(np.maximum(across, up), 0)]
        origin = np.r_[0, np.where(across >= up, np.where(score[:-1] > 0, start[:-1], here[:-1]), start[1:])]
        both = np.maximum.accumulate((now + drift) * wide + origin)  # gaps along the second; the score and where it began go together
        score, start = both // wide - drift, both % wide
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j]), j)
    return best


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """(score, first, end) of the best local alignment of words: 1 for a passage that holds the whole item."""
    if not item or not passage:
        return 0.0, 0, 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(item))}
    score, first, end = align_numbers(np.array([numbers[w] for w in item]), np.array([numbers.get(w, -1) for w in passage]))
    return score / (MATCH * len(item)), first, end


def _numbered(batch: pa.RecordBatch, column: int, vocabulary: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts, their numbers in the vocabulary or -1, lengths of the texts)."""
    words, lengths = cut_words(batch.column(column).to_pylist())
    words = words.filter(pc.not_equal(words, "\0"))
    return words, pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64), lengths


def _count(shared):
    """Texts (second column) to (key, texts that hold it) of all n-grams of the items, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        watch = shared.value
        vocabulary = pa.array(watch.vocabulary, pa.large_string())
        counts = np.zeros(len(watch.keys), np.int64)
        for batch in batches:
            _, ids, lengths = _numbered(batch, 1, vocabulary)
            text = np.repeat(np.arange(len(lengths)), lengths)
            place, key = watch.hits(ids, text, watch.keys)
            counts += np.bincount(np.unique(text[place] * len(counts) + key) % len(counts), minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"gram": met, "n": counts[met]})

    return run


FOUND = "doc_id long, mark long, item_id long, score double, seeds long, matched string"


def _find(shared, least: float):
    """(doc_id, text, mark) to pairs with an item that reach the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        watch = shared.value
        vocabulary = pa.array(watch.vocabulary, pa.large_string())
        for batch in batches:
            words, ids, lengths = _numbered(batch, 1, vocabulary)
            best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
            for text, item, a, b in watch.passages(ids, lengths):
                seeds = watch.may_reach(item, ids[a:b])
                if not seeds:
                    continue
                own = watch.words[watch.starts[item] : watch.starts[item + 1]]
                points, first, end = align_numbers(own, ids[a:b])
                score = points / (MATCH * len(own))
                if score >= least:
                    best[text, item] = max(best.get((text, item), (0.0, 0, 0, 0)), (score, seeds, a + first, a + end))
            if best:
                texts = pa.array([t for t, _ in best], pa.int64())
                matched = [" ".join(words.slice(a, b - a).to_pylist()) for _, _, a, b in best.values()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(texts), batch.column(2).take(texts), pa.array([int(watch.items[i]) for _, i in best], pa.int64()), pa.array([x[0] for x in best.values()]), pa.array([x[1] for x in best.values()], pa.int64()), pa.array(matched, pa.string())],
                    names=["doc_id", "mark", "item_id", "score", "seeds", "matched"],
                )

    return run


def _find_whole(shared):
    """(doc_id, text, mark) to pairs with an item that stands in the text word for word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shared.value
        vocabulary = pa.array(whole.vocabulary, pa.large_string())
        for batch in batches:
            words, ids, lengths = _numbered(batch, 1, vocabulary)
            text = np.repeat(np.arange(len(lengths)), lengths)
            for at, items, n in whole.places(ids, text):
                _, first = np.unique(np.stack([text[at], items]), axis=1, return_index=True)  # one place of a text and item
                at, items = at[first], items[first]
                rows = pa.array(text[at])
                matched = [" ".join(words.slice(a, n).to_pylist()) for a in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(items), pa.array(np.ones(len(at))), pa.array(np.full(len(at), n - 1, np.int64)), pa.array(matched, pa.string())],
                    names=["doc_id", "mark", "item_id", "score", "seeds", "matched"],
                )

    return run


def _pieces(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item_id, piece, item, n): items of n words, each sequence of words once, those beyond PIECE_WORDS in pieces."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL")
    norm = F.trim(F.regexp_replace(F.lower("item"), r"(?U)\W+", " "))
    once = items.groupBy(F.when(norm != "", norm).otherwise(F.col("item")).alias("norm")).agg(F.min_by("item", "item_id").alias("item"), F.min("item_id").alias("item_id"))
    words = F.split("norm", " ")
    counted = once.select("item_id", "item", words.alias("ws"), F.size(words).alias("n"))
    parts = F.ceil(F.col("n") / PIECE_WORDS).cast("int")  # as even as can be, so that none is short
    begin = lambda p: F.floor(p * F.col("n") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.array_join(F.slice("ws", begin(p) + 1, begin(p + 1) - begin(p)), " "))
    pieces = F.when(F.col("n") > PIECE_WORDS, cut).otherwise(F.array("item"))
    return counted.select("item_id", F.posexplode(pieces).alias("piece", "item"), F.least("n", F.lit(PIECE_WORDS)).alias("n"))


def findings(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE, shortest: int = 1) -> DataFrame:
    """(doc_id, mark, item_id, score, seeds, matched) of every row of docs and item of at least `shortest` words that reach the score; mark is a hash of the row's text. See contamination()."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    items = materialize(_pieces(benchmark, item_col, item_text).where(F.col("n") >= shortest), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // PASS_WORDS))
    found = None
    for b in range(blocks):
        some = sorted((r.item_id, r.item) for r in items.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)) == b).collect())  # about PASS_WORDS words
        scored, short = [], []
        for item_id, item in some:
            (scored if len(words_of(item)) * least > 1 + 1e-9 else short).append((item_id, item))
        hits = []
        if scored:
            watch = Watch.of(scored, least)
            sums = arrow_batches(docs, _count(spark.sparkContext.broadcast(watch)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # a row an n-gram of the block at most
            counts = np.zeros(len(watch.keys), np.int64)
            counts[sums["gram"].to_numpy()] = sums["n"].to_numpy()
            hits.append(arrow_batches(docs, _find(spark.sparkContext.broadcast(watch.rarest(counts)), least), FOUND))
        if short:
            hits.append(arrow_batches(docs, _find_whole(spark.sparkContext.broadcast(Whole(short))), FOUND))
        for h in hits:
            found = h if found is None else found.unionByName(h)
    return spark.createDataFrame([], FOUND) if found is None else found


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs that hold no item of LEAST_WORDS words or more; each is judged by its own text, also where ids repeat or are null.

    One to three common words that a short item consists of don't make a document a copy of it.
    """
    found = materialize(findings(docs, benchmark, id_col, text_col, least=least, shortest=LEAST_WORDS).select(F.col("doc_id").alias("found"), "mark").distinct(), "contaminated")
    row = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("own"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))  # the caller's names stay inside
    return row.join(found, F.col("id").eqNullSafe(F.col("found")) & (F.col("own") == F.col("mark")), "left_anti").select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(id, item_id, score, seeds, matched): the documents that hold a copy of a benchmark item, even an edited one.

    Words are runs of letters and digits, in lower case. score is the alignment's share of a
    perfect one; rows from `least` stay, the best of each document and item. seeds: n-grams that
    the densest stretch shares with the item. No pair that reaches the score is lost: see Watch.
    Items with the same words are one, under their least id. Items of so few words that one of
    them would reach the score (two words and less) count where they stand whole, word for word.
    Items beyond PIECE_WORDS words are looked for in pieces, and the best one's score counts: an
    alignment that reaches the score does so on one of them at least. Null ids and texts of items count for nothing; null and empty documents match
    nothing; rows that repeat a document's id give its pairs once. Other columns are not read.

    The benchmark goes out in blocks of about PASS_WORDS words; for each, one pass over the
    corpus counts its n-grams and one finds and aligns, where the texts are read. Passages are
    at most four spans of an item long, so memory follows neither the corpus nor its texts.
    """
    best = findings(docs, benchmark, id_col, text_col, item_col, item_text, least).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "seeds", "matched")).alias("b")).select("doc_id", "item_id", "b.*")
    return best.withColumnRenamed("doc_id", id_col)
