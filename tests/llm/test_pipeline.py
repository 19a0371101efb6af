import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline as P
from scriptorium.llm import decontaminate, simhash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [a + b for a in "ka lo mi pe su ta ne vi do gu".split() for b in "ra li mo te sa fu".split()]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    texts = [prose(rng.randrange(60, 160)) for _ in range(720)]
    toxic = {i for i in range(720) if i % 4 == 0}
    for i in toxic:
        words = texts[i].split()
        for at in (5, 40):
            words[at] = rng.choice(["grimly", "vexor"])
        texts[i] = " ".join(words)
    for _ in range(3):
        texts.append(texts[1])  # copies
    leaky = len(texts)
    texts += [prose(30) + " " + items[k][1] + " " + prose(30) for k in range(5)]
    rows = [(i, t, "xx", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "xx", None, 0)]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(720)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {"folder": folder, "rows": rows, "toxic": toxic, "leaky": set(range(leaky, leaky + 5)), "items": items}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_on_its_own_input(spark, tables):
    folder, docs = tables["folder"], spark.read.parquet(tables["folder"] + "/documents.parquet")
    kept = P.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    gone = set(ids(docs)) - set(ids(kept))
    assert len(gone - tables["toxic"]) <= 15 and len(tables["toxic"] - gone) <= 15
    once = P.drop_near_duplicates(spark, docs, folder)
    fps = {d: simhash.fingerprint_of(t) for d, t, *_ in tables["rows"]}
    group = {d: min(x for x in fps if (fps[x] ^ fps[d]).bit_count() <= 2) for d in fps}
    assert ids(once) == sorted(set(group.values())) and once.columns == docs.columns
    clean = P.drop_contaminated(spark, docs, folder)
    brute = {d for d, t, *_ in tables["rows"] if any(decontaminate.align(decontaminate.words_of(x), decontaminate.words_of(t))[0] >= 0.5 for _, x in tables["items"])}
    assert brute == tables["leaky"] and set(ids(docs)) - set(ids(clean)) == brute
    mixed = P.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(docs))
    size = lambda t: len((t or "").split())
    taken = sum(size(r.text) for r in mixed.collect())
    assert abs(taken - 1.5 * sum(size(t) for _, t, *_ in tables["rows"])) < 0.02 * taken


def test_whole_run(spark, tables):
    out = P.run(spark, tables["folder"]).collect()
    assert out and not {r.doc_id for r in out} & tables["leaky"]
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert P.ORACLE_SQL is None
