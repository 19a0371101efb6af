"""Removal of lines that many documents share, with two Bloom filters before any shuffle of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialize

STRIPPED = " \t\n\x0b\x0c\r"
#: Bits of one piece in which filters are merged.
PIECE = 1 << 16
#: Limits of a filter's bits. Beyond the upper one more lines are suspected, and the exact count settles them.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30
PROBES = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    low = hashes.view(np.uint64)
    step = (low >> np.uint64(33)) | np.uint64(1)
    return [((low + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def _has(bitmap: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(places[0]), dtype=bool)
    for p in places:
        found &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _put(bitmap: np.ndarray, places: list[np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(bitmap, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))


def _fill(bits: int):
    """A task's filters of hashes seen once and seen twice, as the pieces it has touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            places = _places(hashes, bits)
            again = (n > 1) | _has(once, places)
            _put(twice, [p[again] for p in places])
            _put(once, places)
        pack = zstandard.ZstdCompressor(level=1).compress
        size = PIECE // 8
        for piece in np.flatnonzero(once.reshape(-1, size).any(axis=1)).tolist():
            at = slice(piece * size, (piece + 1) * size)
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "once": [pack(once[at].tobytes())], "twice": [pack(twice[at].tobytes())]})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of all tasks: what two tasks have seen once has been seen twice."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for row in batch.to_pylist():
            once, twice = (np.frombuffer(unpack(row[x]), np.uint8) for x in ("once", "twice"))
            if row["piece"] in held:
                o, t = held[row["piece"]]
                t |= twice | (o & once)
                o |= once
            else:
                held[row["piece"]] = (once.copy(), twice.copy())
    for piece, (_, twice) in held.items():
        if twice.any():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "twice": [pack(twice.tobytes())]})


def suspicion(hashes: DataFrame, bits: int):
    """A test on a hash column: false only for hashes that occur once. hashes: one long column.

    Only set bits travel, not the hashes; the merged filter has `bits` bits, which bounds what
    reaches the driver and each worker.
    """
    spark = hashes.sparkSession
    pieces = hashes.mapInArrow(_fill(bits), "piece int, once binary, twice binary")
    merged = pieces.repartition("piece").mapInArrow(_merge, "piece int, twice binary")
    bitmap, size, unpack = np.zeros(bits // 8, np.uint8), PIECE // 8, zstandard.ZstdDecompressor().decompress
    for row in merged.toLocalIterator():
        bitmap[row.piece * size : (row.piece + 1) * size] = np.frombuffer(unpack(bytes(row.twice)), np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def seen_twice(h: pd.Series) -> pd.Series:
        return pd.Series(_has(shared.value, _places(h.to_numpy(np.int64), bits)))

    return F.pandas_udf(seen_twice, T.BooleanType())


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, mark, drops array<int>): positions of the lines to drop, for documents that lose any.

    docs: doc_id, text. mark is a hash of the text; it tells rows apart that share an id.
    """
    n = docs.agg(F.sum(F.size(F.filter(_lines(F.col("text")), lambda line: F.length(line) >= min_chars)))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    # the hash of a text is taken before its lines part, so that no line carries the text
    cut = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.transform(_lines(F.col("text")), line_key).alias("keys"))
    lines = cut.select("doc_id", "mark", F.posexplode_outer("keys").alias("pos", "key")).where(F.char_length("key") >= min_chars)
    suspected = suspicion(lines.select(F.xxhash64("key").alias("h")), bits)
    # SHA-256 stands for a key from here on: equal digests are equal keys, and lines don't travel
    suspects = lines.where(suspected(F.xxhash64("key"))).select("doc_id", "mark", "pos", F.unhex(F.sha2("key", 256)).alias("key"))
    suspects = materialize(suspects, "suspect-lines")
    holders = suspects.select("key", "doc_id").where("doc_id IS NOT NULL").distinct()
    shared = holders.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    shared = materialize(shared.select("key", "keeper"), "shared-lines")  # read anew, so that a frequent key's rows can be split over tasks
    lost = suspects.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, n_lines, n_dropped, kept): each text without the lines that min_docs documents share.

    A line's key is the line stripped of ASCII white space, with A-Z lower-cased. A key of at
    least min_chars code points found in at least min_docs documents keeps its lines only in
    the largest id that holds it, all of them. A null or empty text is one empty line. A
    document is known by its id: rows that repeat one count once, and all keep or lose a line.
    Rows without an id count for nothing and keep no line that others share. Of other columns
    none is read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drops = materialize(repeated_lines(docs, min_chars, min_docs), "line-drops").toDF("of", "of_mark", "drops")
    marked = docs.withColumn("mark", F.xxhash64("text"))
    met = marked.join(drops, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    met = met.withColumn("lines", _lines(F.col("text")))
    edges = F.concat(F.array(F.lit(-1)), F.col("drops"), F.array(F.size("lines")))
    runs = F.transform(F.sequence(F.lit(0), F.size("drops")), lambda k: F.slice(F.col("lines"), edges[k] + 2, edges[k + 1] - edges[k] - 1))
    kept = F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    dropped = F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size("drops"))
    return met.select(F.col("doc_id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept"))
