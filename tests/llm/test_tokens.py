import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from scriptorium.llm import tokens as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())])
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a\n\n  b", "a \n b", "don't we'll 12 34x", "é  x  y", "Ġ x", "<|endoftext|> a", "日本 語", "a\tb c\r\n d", "x" * 5000, "😀 😀", "a\x1c b \x85c", "\nab", "a\nb c\nd\n", "a\t\nb", "x\n\ty", "a.\nB \nc", "a  <|endoftext|>  b", "x<|endoftext|>", "a\x01b \x01 c", "it's. dogs', (a). x_,. 5% a'", "...  ,, a", "é. ø! ñ?", "w\xa0. \xa0x", "日. 本,", " .", "'s 't"]


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_pieces_have_the_ids_of_the_text():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "the", " ", "w", "\n", "é", "'s", ".", "12", "\t", " "]) for _ in range(60)) for _ in range(400)]
    encoder = K.Encoder(PATH)
    got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)]
    assert got == plain(texts)
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == got  # from memory


def test_more_words_than_the_memory_holds(monkeypatch):
    monkeypatch.setattr(K, "CACHE_WORDS", 20)
    monkeypatch.setattr(K, "CALL_WORDS", 3)
    rng = random.Random(2)
    encoder = K.Encoder(PATH)
    for _ in range(5):
        texts = [" ".join(f"w{rng.randrange(60)}" + rng.choice(["", ".", "?!"]) for _ in range(50)) for _ in range(3)]
        assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == plain(texts)
        assert len(encoder.known) <= 21


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 65536, 65537, 200001])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (K.unpack(K.pack(ids, planes)) == ids).all()


def test_positions_and_digests(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_IDS", 50)
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (5, "same id"), (5, "same id")]
    got = K.tokenized(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA), PATH).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(d), len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for (d, _), ids in zip(rows, plain([t for _, t in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_empty_table(spark):
    assert K.tokenized(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_read_tokens(spark, tmp_path):
    df = spark.createDataFrame([(2, "b c", ""), (1, "a", "")], SCHEMA)
    K.write_tokens(df, f"file://{tmp_path}/t", PATH, planes="bit")
    got = {r.doc_id: (r.start, r.ids) for r in K.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    a, b = plain(["a", "b c"])
    assert got == {1: (0, [*a, 2]), 2: (len(a) + 1, [*b, 2])}


def test_frequent_ids_have_several_parts_in_order():
    rng = np.random.default_rng(4)
    docs, marks = rng.choice([1, 5, 5, 5, 5, 9], 1000), rng.integers(-(2**63), 2**63 - 1, 1000)
    missing = rng.random(1000) < 0.2
    part = K._part(docs, missing, marks, np.array([1, 5, 5, 5, 5, 9]), 3)
    order = np.lexsort((marks, np.where(missing, 0, docs), ~missing))
    assert (np.diff(part[order]) >= 0).all() and len(set(part[(docs == 5) & ~missing].tolist())) == 4 and set(part[missing].tolist()) == {-3, -2, -1}
