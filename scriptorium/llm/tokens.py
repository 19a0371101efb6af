"""Token ids in shuffled byte planes: writing, reading back, and positions of documents."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_batches, arrow_limits, materialize, shared_dir

MAGIC = b"PLN1"
#: Ids of one block (transposed and compressed plane by plane) and of one chunk (a row of the files).
BLOCK_IDS, CHUNK_IDS = 1 << 16, 1 << 19
#: Stretches of ascending ids that the files are dealt into, at most.
MOST_PARTS = 100_000
#: Words that a worker remembers the ids of, and those that one call of the tokenizer is given at a time.
CACHE_WORDS, CALL_WORDS = 300_000, 500
#: Every kind of white space that a pre-tokenizer may know, as a class of RE2 (fixed values).
SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A character that parts pieces; texts that hold it are encoded whole.
MARK = "\x01"
STOPS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD_END = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]$"


def _strings(column: pa.StringArray) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] of every i, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer never joins a visible character to following white space, and of a run of
    white space only the last character can go with what follows. So a text can be cut before
    each space or line end that a visible character follows, and the ids of the pieces are the
    ids of the text; a word likewise before the signs that end it. Pieces recur, so each
    distinct word goes through the library once a worker, as long as it is among the first
    CACHE_WORDS, and else once a batch. Texts that hold an added token's string are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of their own cost memory each
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.kind = np.dtype("<u2" if len(self.opens) <= 1 << 16 else "<u4")
        self.opens[[i for t, i in vocab.items() if t[0] in "ĠĊ"]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {"": 0}  # number of a word; its ids are flat[edges[n] : edges[n + 1]]
        self.flat, self.edges = np.empty(0, self.kind), np.zeros(2, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, how many each has). Words after one space are told apart in a longer text by the tokens that open with it."""
        plain = pc.match_substring_regex(pa.array(words, pa.string()), rf"^[ \n][^{SPACES}]+$").to_numpy(zero_copy_only=False)
        spaced, others = [w for w, p in zip(words, plain, strict=True) if p], [w for w, p in zip(words, plain, strict=True) if not p]
        found: list[np.ndarray] = []
        sizes = np.zeros(len(words), np.int64)
        counts: list[np.ndarray] = []
        for ids in self._ids(["".join(spaced[i : i + CALL_WORDS]) for i in range(0, len(spaced), CALL_WORDS)]):
            counts.append(np.diff(np.r_[np.flatnonzero(self.opens[ids]), len(ids)]))
            found.append(ids)
        sizes[plain] = np.concatenate([*counts, np.zeros(0, np.int64)])
        single = self._ids(others)
        sizes[~plain] = [len(x) for x in single]
        both = np.concatenate([*found, *single, np.empty(0, self.kind)])
        place = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]  # word of each stretch of both
        starts = np.empty(len(words), np.int64)
        starts[place] = np.cumsum(sizes[place]) - sizes[place]
        return _gather(both, starts, sizes), sizes

    def _numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of distinct words, flat, edges) after learning those not known; those that don't fit the memory are only in the flat and edges returned."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        flat, edges = self.flat, self.edges
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids, sizes = self._learn(fresh)
            first = len(edges) - 1
            at[new] = first + np.arange(len(new))
            flat, edges = np.concatenate([flat, ids]), np.concatenate([edges, edges[-1] + np.cumsum(sizes)])
            room = max(0, CACHE_WORDS - first)
            if room:
                self.known.update(zip(fresh[:room], range(first, first + room), strict=False))
                self.edges = edges[: first + 1 + min(room, len(new))].copy()
                self.flat = flat[: self.edges[-1]].copy()
        return at, flat, edges

    def _pieces(self, texts: pa.StringArray, whole: pa.BooleanArray) -> pa.ListArray:
        cut = texts
        for space in " \n":
            cut = pc.replace_substring(cut, space, MARK + space)
        runs = pc.match_substring_regex(texts, rf"[ \n](?:[{SPACES}]|\z)")  # only there a space may have no visible character behind it
        if pc.any(runs).as_py():
            cut = pc.replace_with_mask(cut, runs, pc.replace_substring_regex(texts.filter(runs), rf"([ \n])([^{SPACES}])", MARK + r"\1\2"))
        if pc.any(whole).as_py():
            cut = pc.if_else(whole, "", cut)
        return pc.split_pattern(cut, MARK)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian integers of `kind`; none for a null or empty one."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        if not len(texts):
            return []
        whole = pc.match_substring(texts, MARK)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        pieces = self._pieces(texts, whole)
        per_text = pieces.value_lengths().to_numpy(zero_copy_only=False)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary
        stems = pc.ascii_rtrim(distinct, characters=STOPS)
        stems = pc.if_else(pc.match_substring_regex(stems, _WORD_END), stems, distinct)
        bare = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        tailed = np.flatnonzero(bare < pc.binary_length(distinct).to_numpy(zero_copy_only=False))
        tails = [w[len(s) :] for w, s in zip(_strings(distinct.take(pa.array(tailed))), _strings(stems.take(pa.array(tailed))), strict=True)]
        stems = stems.dictionary_encode()
        words = dict.fromkeys(_strings(stems.dictionary))  # a tail may be a stem as well
        order = {w: i for i, w in enumerate(words | dict.fromkeys(tails))}
        number, flat, edges = self._numbers(list(order))
        both = np.zeros((len(distinct), 2), np.int64)  # number of the stem and of the tail, 0 for none
        both[:, 0] = number[: len(words)][stems.indices.to_numpy(zero_copy_only=False)]
        both[tailed, 1] = number[[order[t] for t in tails]] if tails else 0
        sizes = edges[both + 1] - edges[both]
        flat = _gather(flat, edges[both].ravel(), sizes.ravel())  # ids of the distinct pieces
        sizes = sizes.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        raw = _gather(flat, starts[at], sizes[at]).tobytes()
        ends = np.r_[0, np.cumsum(sizes[at])][np.cumsum(per_text)] * self.kind.itemsize
        out = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        held = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, ids in zip(held.tolist(), self._ids(_strings(texts.take(pa.array(held)))), strict=True):
            out[i] = ids.tobytes()
        return out


def pack(ids: np.ndarray, planes: str = "byte") -> bytes:
    """Chunk: magic, plane kind, ids, block size; a table of compressed plane lengths; the planes."""
    compress = zstandard.ZstdCompressor(level=1).compress
    lengths, body = [], []
    for at in range(0, len(ids), BLOCK_IDS):
        octets = np.ascontiguousarray(ids[at : at + BLOCK_IDS], dtype="<u4").view(np.uint8).reshape(-1, 4)
        if planes == "bit":
            rows = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
        else:
            rows = octets.T
        for row in rows:
            body.append(compress(np.ascontiguousarray(row).tobytes()))
            lengths.append(len(body[-1]))
    head = struct.pack("<4sBQI", MAGIC, 1 if planes == "bit" else 0, len(ids), BLOCK_IDS)
    return head + np.array(lengths, dtype="<u4").tobytes() + b"".join(body)


def unpack(chunk: bytes) -> np.ndarray:
    magic, bitwise, n, block = struct.unpack_from("<4sBQI", chunk)
    if magic != MAGIC:
        raise ValueError("not a chunk of this format")
    planes, at = (32 if bitwise else 4), struct.calcsize("<4sBQI")
    blocks = -(-n // block)
    lengths = np.frombuffer(chunk, "<u4", blocks * planes, at)
    at += lengths.nbytes
    decompress, out = zstandard.ZstdDecompressor().decompress, np.empty(n, dtype="<u4")
    for b in range(blocks):
        size = min(block, n - b * block)
        rows = []
        for length in lengths[b * planes : (b + 1) * planes].tolist():
            rows.append(np.frombuffer(decompress(chunk[at : at + length]), np.uint8))
            at += length
        octets = np.stack(rows)
        if bitwise:
            octets = np.packbits(np.unpackbits(octets, axis=1, count=size, bitorder="little").T, axis=1, bitorder="little")
        else:
            octets = octets.T
        out[b * block : b * block + size] = np.ascontiguousarray(octets).view("<u4")[:, 0]
    return out


_ENCODERS: dict[str, Encoder] = {}
CHUNKS = "part int, chunk int, start long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def _part(docs: np.ndarray, missing: np.ndarray, marks: np.ndarray, edges: np.ndarray, apart: int) -> np.ndarray:
    """Part of each row: the stretch between two edges that its id falls in.

    An id that is several edges holds so many rows that it has as many parts; rows without an
    id have the `apart` parts below zero. Such rows are dealt by their mark, in its order.
    """
    share = (marks.astype(np.float64) + 2.0**63) / 2.0**64
    low, high = np.searchsorted(edges, docs, "left"), np.searchsorted(edges, docs, "right")
    many = np.maximum(1, high - low)
    part = low + np.minimum((share * many).astype(np.int64), many - 1)
    return np.where(missing, np.minimum((share * apart).astype(np.int64), apart - 1) - apart, part).astype(np.int32)


def _encode(path: str, edges, apart: int):
    """Rows (doc_id, mark, text) to (part, doc_id, mark, width, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            docs, marks, ids = batch.column(0), batch.column(1), encoder.encode(batch.column(2))
            missing = docs.is_null().to_numpy(zero_copy_only=False)
            part = _part(docs.fill_null(0).to_numpy(zero_copy_only=False), missing, marks.to_numpy(zero_copy_only=False), edges.value, apart)
            yield pa.RecordBatch.from_arrays([pa.array(part), docs, marks, pa.array([encoder.kind.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["part", "doc_id", "mark", "width", "ids"])

    return run


def _write(end_id: int, planes: str):
    """Sorted rows of _encode to chunks; a chunk ends with its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, start, size = None, 0, 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        end = np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            nonlocal chunk, start, size
            row = {
                "part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "start": [start], "n_ids": [size],
                "doc_ids": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "data": [pack(np.concatenate(held), planes)],
            }
            chunk, start, size = chunk + 1, start + size, 0
            out = pa.RecordBatch.from_pydict(row)
            docs.clear(), lengths.clear(), held.clear()
            return out

        for batch in batches:
            for own, doc, width, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if own != part:
                    if docs:
                        yield flush()
                    part, chunk, start = own, 0, 0
                docs.append(doc)
                held += (np.frombuffer(ids, f"<u{width}").astype("<u4"), end)
                lengths.append(len(held[-2]) + 1)
                size += lengths[-1]
                if size >= CHUNK_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, planes: str = "byte") -> None:
    """Writes docs (doc_id, text) to `out`: parts in ascending doc_id order, null ids first.

    A row of the files is a chunk of whole documents: the chunk index (part, chunk, start,
    n_ids, ids and lengths of its documents) and the shuffled, compressed ids. Texts are encoded
    where they are read; only ids move, to the part of their doc_id, whose edges are
    approximate percentiles; an id that is several of them, and rows without an id, are dealt
    over several parts. Rows that share an id follow each other by a hash of their text.
    Spark's writer commits the files, so a lost executor costs its tasks only.
    """
    spark = docs.sparkSession
    parts = min(MOST_PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges, rows, named = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts), F.count(F.lit(1)), F.count("doc_id")).first()
    apart = max(1, parts * (rows - named) // max(1, rows))
    shared = spark.sparkContext.broadcast(np.array(edges or [], np.int64))
    encoded = arrow_batches(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), _encode(tokenizer, shared, apart), "part int, doc_id long, mark long, width int, ids binary")
    with arrow_limits(spark):
        encoded.repartition("part").sortWithinPartitions("part", "doc_id", "mark").mapInArrow(_write(end_id, planes), CHUNKS).write.parquet(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw, lengths = unpack(row["data"]).tobytes(), np.array(row["lengths"], dtype=np.int64)
            ends = np.cumsum(lengths)
            cuts = np.r_[0, 4 * ends].tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": row["base"] + row["start"] + ends - lengths, "n_tokens": lengths,
                "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
            })


def _based(files: DataFrame) -> DataFrame:
    """files with base, the ids of all parts before a row's own; there is one row a part to sum."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(F.broadcast(base), "part")  # write_tokens makes at most MOST_PARTS parts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, cuts = unpack(row["data"]), np.r_[0, np.cumsum(row["lengths"])].astype(np.int64)
            starts = pa.array(row["base"] + row["start"] + cuts[:-1], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": starts, "ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.uint32()).cast(pa.int64()))})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<long>) of files that write_tokens has made."""
    return arrow_batches(_based(spark.read.parquet(path)), _texts, "doc_id long, start long, ids array<long>", rows=4)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of files that write_tokens has made, from their ids."""
    return arrow_batches(_based(spark.read.parquet(path)), _digest, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=8)


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, planes: str = "byte") -> DataFrame:
    """Writes all documents to a new folder in the shared one and returns the digest of what it reads back.

    A null or empty text has only the end id. Rows that repeat an id are documents of their
    own. An empty table gives no rows. Of other columns none is read.
    """
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tables/token-files-{uuid.uuid4().hex}"
    write_tokens(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), out, tokenizer, end_id, planes)
    with arrow_limits(spark, 8):
        digest = materialize(token_digest(spark, out), "token-digest")  # narrow rows
    return digest.withColumnRenamed("doc_id", id_col)
