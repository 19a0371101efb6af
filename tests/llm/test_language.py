import math
import random

import numpy as np
from pyspark.sql import types as T

from scriptorium.llm import language as L

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("lang", T.StringType())])
DOCS = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("url", T.StringType())])
SYLLABLES = {"aa": ["ka", "ki", "ku", "ta"], "bb": ["mo", "no", "lo", "ro"], "cc": ["zee", "vee", "wée", "bee"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def make(rng):
    docs = [(prose(rng, lang, 50), lang, "") for lang in SYLLABLES for _ in range(40)] + [(None, "aa", ""), ("x", None, ""), ("", "bb", "")]
    pages, truth = [], {}
    for i in range(240):
        lang = list(SYLLABLES)[i % 3]
        host = f"h{i % 3}.example.{lang}" if i % 5 else "mixed.example.org"
        declared = f' lang="{lang}-X"' if i % 4 else ""
        pages.append((i, f"http://{host}/{i}", f"<html{declared}><script>{prose(rng, 'aa', 30)}</script><p>{prose(rng, lang, rng.randrange(3, 30))}", ""))
        truth[i] = lang
    return docs, pages, truth


def brute(docs, pages):
    languages = sorted({lang for _, lang, _ in docs if lang})
    table = np.full((len(languages), L.BUCKETS), 0.5)
    for text, lang, _ in docs:
        if lang and text is not None:
            table[languages.index(lang)] += L.trigram_counts(text)
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    n, rows = len(languages), []
    for _, url, html, _ in pages:
        s = L.TEMPER * ((logs - logs.mean(axis=0)) @ L.trigram_counts(L.plain_text(html)))
        s = np.maximum(s - s.max(), -L.MOST_NATS)
        host = url.split("://")[1].split("/")[0] if url and "://" in url else ""
        rows.append({"s": s, "told": bool((s != 0).any()), "guess": int(s.argmax()), "host": host, "suffix": host.rpartition(".")[2], "declared": L.declared_of(html) or ""})

    def tally(test, skip):
        out = np.zeros(n)
        for r in rows:
            if r["told"] and test(r) and r is not skip:
                out[r["guess"]] += 1
        return out

    found = []
    for r in rows:
        whole, host, suffix, declared = (tally(t, r) for t in (lambda x: True, lambda x, r=r: x["host"] == r["host"], lambda x, r=r: x["suffix"] == r["suffix"], lambda x, r=r: x["declared"] == r["declared"]))
        base = (whole + 1) / (whole.sum() + n)
        by_suffix = (suffix + 10 * base) / (suffix.sum() + 10)
        prior = (host + 10 * by_suffix) / (host.sum() + 10)
        post = r["s"] + np.log(prior) + (np.log((declared + base) / (declared.sum() + 1) / base) if r["declared"] else 0) + (np.log(by_suffix / base) if r["suffix"] else 0)
        found.append((languages[int(post.argmax())], 1 / np.exp(post - post.max()).sum()))
    return found


def test_matches_brute_force(spark):
    docs, pages, truth = make(random.Random(2))
    pages += [(900, None, None, ""), (901, "http://h0.example.aa/", "", ""), (902, "bad", '<html lang=bb>', ""), (3, pages[3][1], pages[3][2], ""), (None, "http://x.example.cc/", "<p>" + "zee " * 50_000, "")]
    got = L.identify(spark.createDataFrame(pages, PAGES), spark.createDataFrame(docs, DOCS)).collect()
    want = brute(docs, pages)
    assert len(got) == len(pages)
    by_id = {r.page_id: r for r in got}
    for (page, *_), (lang, confidence) in zip(pages, want, strict=True):
        assert by_id[page].lang == lang, page
        assert math.isclose(by_id[page].confidence, confidence, rel_tol=1e-6)
    assert np.mean([by_id[i].lang == lang for i, lang in truth.items()]) > 0.98
    assert by_id[901].lang == "aa" and by_id[902].lang == "bb"


def test_no_labelled_text_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x", "")], PAGES)
    assert [r.lang for r in L.identify(pages, spark.createDataFrame([], DOCS)).collect()] == [None]
    assert L.identify(spark.createDataFrame([], PAGES), spark.createDataFrame([("ka", "aa", "")], DOCS)).count() == 0


def test_declared_language():
    for page, lang in [
        ('<!-- <html lang="de"> --><html lang="fr">', "fr"), ('<html data-lang="de">x', None), ("<HTML class=a LANG='En-gb'>", "en"), ("<html><meta http-equiv=Content-Language content=es>", "es"), ("<script><html lang=de></script>", None),
        ("<html lang=''><meta name=content-language content='it, en'>", "it"), (None, None), ("", None), ("<html lang=german>", None), ("<p lang=de>", None), ("<meta content-language" * 2000, None), ("<html lang=de", None),
    ]:
        assert L.declared_of(page) == lang, page
    assert L.plain_text("a<script>b</script><template><p>c</template>d &amp; e<noscript>f</noscript>").split() == ["a", "d", "&", "e"]


def test_rare_languages_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    texts = {"aa": "lorem ipsum dolor sit amet ", "bb": "xyzzy plugh quux frob ", "cc": "tik tak tok tuk ", "dd": "tik tak tik tak "}
    docs = spark.createDataFrame([(t * 5 + str(i), k) for k, t in texts.items() for i in range(9 if k < "cc" else 2)] + [(f"stray {i}", f"l{i}") for i in range(40)], "text string, lang string")
    languages, logs = L.train(docs)
    assert languages == ["aa", "bb", "other"] and logs.shape == (3, L.BUCKETS)
    pages = spark.createDataFrame([(i, f"<p>{t * 20}", None) for i, t in enumerate(texts.values())], "page_id long, html string, url string")
    assert [r.lang for r in L.identify(pages, docs).orderBy("page_id").collect()] == ["aa", "bb", "other", "other"]
