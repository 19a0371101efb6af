import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import decontaminate as D

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / (2 * len(a))


def holds(words, item):
    return any(words[i : i + len(item)] == item for i in range(len(words)))


def test_alignment_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, first, end = D.align(a, b)
        assert score == brute_align(a, b)
        assert score == 0 or brute_align(a, b[first:end]) == score


def test_finds_copies_and_leaves_clean_documents(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(15, 50))) for i in range(30)]
    rows, want = [], set()
    for d in range(120):
        body = prose(rng, 200).split(" ")
        if d % 3 == 0:
            i = 0 if d % 2 else rng.randrange(30)  # item 0 in many documents
            words = items[i][1].split(" ")
            if d % 4 == 0:
                words = [w.upper() + "," if k % 2 else w for k, w in enumerate(words)]
            if d % 5 == 0:
                for k in range(3, len(words), 7):
                    words[k] = "edited"
            body[50:50] = words
            want.add((d, i))
        rows.append((d, " ".join(body)))
    rows += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1]), (None, items[4][1]), (903, (prose(rng, 50) + " ") * 300 + items[5][1])]
    want |= {(902, 3), (None, 4), (903, 5)}
    items += [(77, items[6][1].upper()), (80, None), (81, ""), (82, "the of"), (None, "a b c d e")]
    want |= {(d, 82) for d, t in rows if holds(D.words_of(t), ["the", "of"])}  # an item of two words counts where it stands whole
    got = D.contamination(spark.createDataFrame([(d, t, "") for d, t in rows], DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.score for r in got if r.doc_id == 902} == {1.0}
    monkeypatch.setattr(D, "PASS_WORDS", 200)
    again = D.contamination(spark.createDataFrame([(d, t, "") for d, t in rows], DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in again} == want


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b c d", "")], DOCS)
    assert D.contamination(docs, none).count() == 0
    assert D.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d", "")], ITEMS)).count() == 0


def test_frequent_seeds_still_find_edited_copies(spark):
    rng = random.Random(5)
    item = [f"w{k}" for k in range(16)]
    copy = ["edited" if k in (3, 9, 14) else w for k, w in enumerate(item)]  # each word kept but the last has another within two
    texts = [" ".join([prose(rng, 20), *item[p : p + 4], prose(rng, 20)]) for p in range(13) for _ in range(55 if p in (0, 8) else 60)]
    texts.append(" ".join([prose(rng, 20), *copy, prose(rng, 20)]))
    got = D.contamination(spark.createDataFrame([(d, t, "") for d, t in enumerate(texts)], DOCS), spark.createDataFrame([(1, " ".join(item), "")], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.score, r.seeds) for r in got] == [(len(texts) - 1, 1, 23 / 32, 12)]


def pairs_of(watch, texts):
    """What one task finds, without Spark."""
    words = [D.words_of(t) for t in texts]
    number = {w: i for i, w in enumerate(watch.vocabulary)}
    ids = np.array([number.get(w, -1) for own in words for w in own], np.int64)
    return {(t, item) for t, item, a, b in watch.passages(ids, np.array([len(w) for w in words])) if watch.may_reach(item, ids[a:b])}


def test_cut_words():
    texts = [None, "", "  ", "A-b_c, d\x00e é–ß 日本 x…", "İı ¿qué? 12½", "\u0301a b\u0301"]
    words, lengths = D.cut_words(texts)
    assert [w for w in words.to_pylist() if w != "\0"] == [w for t in texts for w in D.words_of(t)]
    assert lengths.tolist() == [len(D.words_of(t)) for t in texts]


def test_no_pair_that_reaches_the_score_is_lost():
    rng, reached, spared, edited = random.Random(6), 0, 0, 0
    letters = "abcdefghijklmnop"
    for trial in range(400):
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(4, 14)))) for i in range(3)]
        texts = []
        for _ in range(4):
            item, kept = items[rng.randrange(3)][1].split(), rng.choice([0.5, 0.7, 0.9])
            passage = [rng.choice(letters + 20 * "ABCDEFGH") if trial % 2 else "zz" for _ in range(rng.randrange(60))]
            passage[10:10] = [w for k in item for w in ((k, "x") if rng.random() < 0.4 else (k,) if rng.random() < kept else rng.choice([(), ("y",)]))]
            texts.append(" ".join(passage))
        watch = D.Watch.of(items)
        if trial % 4 < 2:  # whatever the counts are
            watch.rarest(np.array([rng.randrange(5) for _ in watch.keys]))
        may = pairs_of(watch, texts)
        for t, text in enumerate(texts):
            for i, item in items:
                good = brute_align(D.words_of(item), D.words_of(text)) >= D.LEAST_SCORE
                assert not good or (t, i) in may, (item, text)
                reached, spared, edited = reached + good, spared + ((t, i) not in may), edited + (good and item not in text)
    assert reached > 300 and spared > 300 and edited > 200


def test_every_third_or_fourth_word_replaced():
    rng = random.Random(7)
    item = [f"w{k}" for k in range(60)]
    for step in (3, 4, 5):
        copy = ["edited" if k % step == 0 else w for k, w in enumerate(item)]
        text = " ".join([prose(rng, 30), *copy, prose(rng, 30)])
        assert brute_align(item, copy) >= 0.5
        assert pairs_of(D.Watch.of([(1, " ".join(item))]), [text]) == {(0, 0)}
    apart = [x for w in item for x in (w, "z")]  # a word between any two
    assert pairs_of(D.Watch.of([(1, " ".join(item))]), [" ".join(apart)]) == {(0, 0)}


def test_all_pairs_of_the_small_tables(spark):
    """Recall and precision against an alignment of every document with every item."""
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.score for r in D.contamination(docs, items).collect()}
    want = {}
    for d in docs.collect():
        words = D.words_of(d.text)
        for i in items.collect():
            if (score := D.align(D.words_of(i.text), words)[0]) >= D.LEAST_SCORE:
                want[d.doc_id, i.item_id] = score
    assert got == want and want


def test_long_documents_are_aligned_in_windows():
    item = [f"w{k}" for k in range(20)]
    text = " ".join(["w3", "w4", "q"] * 400 + item + ["w7", "w8", "q"] * 400)
    watch = D.Watch.of([(1, " ".join(item))])
    number = {w: i for i, w in enumerate(watch.vocabulary)}
    ids = np.array([number.get(w, -1) for w in text.split()])
    cut = list(watch.passages(ids, np.array([len(ids)])))
    assert all(b - a <= 4 * watch.span[0] for _, _, a, b in cut) and len(cut) > 10
    assert max(D.align_numbers(watch.words, ids[a:b])[0] for _, _, a, b in cut) == 40


def test_clean_rows_are_judged_by_their_own_text(spark):
    item = "one two three four five six"
    rows = [(1, f"x {item} y", "a"), (1, "clean text of the same id", "b"), (None, f"{item}", "c"), (None, "clean without id", "d"), (2, None, "e"), (3, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string").withColumn("mark", F.lit("m"))
    got = D.clean_rows(df, spark.createDataFrame([(1, item, "")], ITEMS))
    assert got.columns == df.columns
    assert sorted(r.found for r in got.collect()) == ["b", "d", "e", "f"]


def test_short_items_equal_brute_force(spark):
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    texts = [(d, some(rng.randrange(12))) for d in range(60)] + [(90, None), (91, ""), (92, "Here alpha, beta GAMMA stands"), (92, "Here alpha, beta GAMMA stands"), (93, "alpha beta"), (94, "lone" + " x" * 3000 + " zig-zag"), (None, "zig zag")]
    texts += [(95, "½")]
    items = {1: "a", 2: "b c", 3: "d e f", 4: "alpha beta gamma", 5: "zig zag", 6: "c c", 7: "g h i j a", 9: "...", 10: "½", 11: "²"}
    docs = spark.createDataFrame([(d, t, "") for d, t in texts], DOCS)
    bench = spark.createDataFrame([*[(i, t, "") for i, t in items.items()], (8, "B, c", "")], ITEMS)  # 8 is 2 again
    for least in (0.5, 0.2):
        want = set()
        for d, t in texts:
            for i, item in items.items():
                words, own = D.words_of(t), D.words_of(item)
                if len(own) * least > 1 + 1e-9:
                    if words and brute_align(own, words) >= least:
                        want.add((d, i))
                elif own and holds(words, own):
                    want.add((d, i))
        got = D.contamination(docs, bench, least=least).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert {r.matched for r in got if (r.doc_id, r.item_id) == (92, 4)} == {"alpha beta gamma"}
    kept = {(r.doc_id, r.text) for r in D.clean_rows(docs, bench.where("item_id < 6")).collect()}
    assert kept == {(d, t) for d, t in texts}  # few words are no reason to drop a document


def test_long_items_are_found_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    item = prose(rng, 95).split(" ")
    edited = ["edited" if k % 9 == 4 else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 20 + edited + ["y"] * 20), ""), (2, prose(rng, 300), ""), (3, " ".join(item), "")], DOCS)
    bench = spark.createDataFrame([(7, " ".join(item), ""), (8, prose(rng, 12), "")], ITEMS)
    whole = D.contamination(docs, bench).collect()
    monkeypatch.setattr(D, "PIECE_WORDS", 30)
    monkeypatch.setattr(D, "PASS_WORDS", 40)
    pieces = D._pieces(bench, "item_id", "text").orderBy("item_id", "piece").collect()
    assert [len(r.item.split(" ")) for r in pieces] == [23, 24, 24, 24, 12] and " ".join(r.item for r in pieces[:4]) == " ".join(item)
    got = D.contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(r.doc_id, r.item_id) for r in whole} == {(1, 7), (3, 7)} and len(got) == 2
