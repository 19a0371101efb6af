import random

import numpy as np
from pyspark.sql import types as T

from scriptorium.llm import toxicity as X
from scriptorium.llm.common import words_of

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("ka lo mi pe su ta".split()) + rng.choice("ra ne li".split()) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["grimly", "vexor", "blaight" + rng.choice("abcdef")])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(900, 3)
    odd = [(5000, None), (5001, ""), (None, "ka lo"), (5002, "vexor " * 20000), (0, rows[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows + odd], DOCS)
    got = X.toxicity(df, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {d: y for d, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.doc_id: r.predicted for r in got}[5002] == 1


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, None, "")], DOCS)
    assert [r.predicted for r in X.toxicity(df, spark.createDataFrame([], LABELS)).collect()] == [0, 0]
    assert X.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def random_model(seed=0):
    model, rng = X.untrained(), np.random.default_rng(seed)
    model.table, model.filters, model.out, model.bias = (rng.normal(size=a.shape).astype(np.float32) for a in (model.table, model.filters, model.out, model.bias))
    return model


def plain_logit(model, text):
    """The same network for one text, word by word."""
    words = words_of(text)
    x = [sum(model.table[r] for r in X.word_rows(w)) for w in words] + [np.zeros(X.DIMS, np.float32)] * X.PAD
    tops, column = [[] for _ in range(X.TOP)], 0
    for width in X.WIDTHS:
        for f in range(X.FILTERS):
            number = X.WIDTHS.index(width) * X.FILTERS + f
            found = sorted((model.bias[number] + sum(float(x[i + tap] @ model.filters[:, column + tap * X.FILTERS + f]) for tap in range(width)) for i in range(len(words))), reverse=True)
            for k in range(X.TOP):
                tops[k].append(max(0.0, found[k]) if k < len(found) else 0.0)
        column += width * X.FILTERS
    return float(np.concatenate(tops) @ model.out + model.out_bias)


def test_matches_a_plain_convolution(monkeypatch):
    model, rng = random_model(), random.Random(1)
    texts = ["alpha beta", "", "gamma", None, "one two three one two one", "!? x"] + [" ".join(rng.choice("ka lo mi pe su ta".split()) for _ in range(rng.randrange(40))) for _ in range(20)]
    want = [plain_logit(model, t) for t in texts]
    assert np.allclose(model.logits(X.read(texts)), want, atol=1e-2)
    monkeypatch.setattr(X, "SPAN", 7)  # long texts go in stretches
    assert np.allclose(model.logits(X.read(texts)), want, atol=1e-2)


def test_gradients_match_differences():
    model, rng = random_model(3), random.Random(2)
    for name in ("table", "filters", "out", "bias"):
        setattr(model, name, (getattr(model, name) * 0.3).astype(np.float64))
    texts = [" ".join(rng.choice("ka lo mi pe su ta ne vi".split()) for _ in range(rng.randrange(1, 12))) for _ in range(6)]
    words, labels, weight = X.read(texts), np.array([0, 1, 1, 0, 1, 0], float), np.array([1, 2, 1, 1, 0.5, 1])
    _, (filters, bias, out, out_bias), touched, rows = X.gradients(model, words, labels, weight)
    loss = lambda: X.gradients(model, words, labels, weight)[0]

    def slope(array, at, step=1e-5):
        array[at] += step
        up = loss()
        array[at] -= 2 * step
        down = loss()
        array[at] += step
        return (up - down) / (2 * step)

    for at in [(0, 0), (3, 10), (7, 20), (11, 40)]:
        assert np.isclose(slope(model.filters, at), filters[at], rtol=2e-2, atol=1e-4)
    for at in (0, 5, 12, 23):
        assert np.isclose(slope(model.bias, at), bias[at], rtol=2e-2, atol=1e-4)
    for at in (0, 9, 30, 60):
        assert np.isclose(slope(model.out, at), out[at], rtol=2e-2, atol=1e-4)
    for i, word in list(enumerate(touched))[:4]:
        at = (words.rows[word, 0], 2)
        same = [j for j, other in enumerate(touched) for part in range(X.PARTS) if words.rows[other, part] == at[0]]
        assert np.isclose(slope(model.table, at), sum(rows[j, 2] for j in same), rtol=2e-2, atol=1e-4)


def test_texts_do_not_touch_each_other():
    model = random_model()
    texts = ["alpha beta", "", "gamma", None, "delta " * 70000]
    together = model.logits(X.read(texts))
    assert np.allclose(together, [model.logits(X.read([t]))[0] for t in texts], atol=1e-3)
    whole, some = X.read(texts), np.array([4, 0, 1])
    assert np.allclose(model.logits(whole.of(some)), together[some], atol=1e-3)


def test_errors_weigh_by_the_real_share_of_labels():
    sums = [(0, 0, 60, 0), (0, 64, 30, 10), (0, 128, 10, 90)]  # errors by cut before step 0, 64, 128: 100 clean, 40 clean, 10 toxic and 10 clean
    assert X._thresholds(sums, 100, 100, 1)[0] == 1.5
    assert X._thresholds(sums, 100, 1000, 1)[0] == 0.5  # a toxic text stands for ten: 40 against 110
    assert X._thresholds(sums, 10_000, 100, 1)[0] > 1.5 - 1e-9
    assert not X._thresholds([], 0, 0, 1).any()


def test_rare_language_is_calibrated_by_its_own_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "SAMPLE_TOXIC", 40)
    monkeypatch.setattr(X, "SAMPLE_CLEAN", 80)
    seen = []
    monkeypatch.setattr(X, "_thresholds", lambda sums, clean, toxic, n: seen.append((sums, n)) or np.zeros(n + 1))
    rows, labels = corpus(900, 4)
    rows = [(d, t + " der die und das" if d % 9 == 0 else t, "de" if d % 9 == 0 else "xx") for d, t in rows]
    df = spark.createDataFrame([(d, t, lang) for d, t, lang in rows], "doc_id long, text string, lang string")
    model, left, marked = X.train(df, spark.createDataFrame(labels, LABELS), None)
    assert left.count() == 900 - 96 and marked.count() == 900
    assert X.scored(df, spark.createDataFrame(labels, LABELS)).count() == 900
    (sums, n), german = seen[0], [k for w, votes in model.markers.items() if w == "und" for k, _ in votes]
    assert n == 2 and german == [0]
    assert sum(c + y for _, _, c, y in sums) == 900 - 96  # all labelled rows but those fitted on
    assert sum(c + y for k, _, c, y in sums if k == 0) > 80
    german = [t for _, t, lang in rows if lang == "de"]
    assert (model.language_of(X.read(german)) == 0).all() and model.language_of(X.read(["und das", "zzz", None])).tolist() == [0, 2, 2]


def test_rows_that_stay_have_all_their_columns(spark):
    rows, labels = corpus(600, 5)
    df = spark.createDataFrame([(d, t, f"s{d}", d) for d, t in rows], "doc_id long, text string, row string, logit long")
    kept = X.drop_toxic(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    got, bad = {r.doc_id: r for r in kept.collect()}, {d for d, _, y in labels if y}
    assert all(r.row == f"s{d}" and r.logit == d for d, r in got.items())
    assert len(bad & set(got)) <= 20 and len(set(dict(rows)) - bad - set(got)) <= 20
