"""SimHash near-duplicate detection with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, materialize
from .graph import connected_components

SEED = 42
BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Distinct fingerprints of one bucket above which it is divided again.
HOT_BUCKET = 4096
#: Rows (a query fingerprint against 64 others) compared at once.
STEP = 1 << 15


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        grams = zip(*(words[i:] for i in range(width)), strict=False)
        hashes = np.fromiter((digest(b" ".join(g), SEED) for g in grams), dtype=np.uint64, count=len(words) - width + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 16384):
        octets = hashes[at : at + 16384].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(x) for x in text], dtype=np.uint64).astype(np.int64)


def _part(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def bucket_keys(fp: Column, radius: int, low: int = 0, width: int = BITS) -> Column:
    """Keys of which two values at most `radius` bits apart in bits [low, low + width) share one.

    Those bits are cut into radius + 2 parts; a pair that differs in at most `radius` bits
    agrees in two parts whole, so each pair of parts gives a key.
    """
    n = radius + 2
    cuts = [low + width * i // n for i in range(n + 1)]
    keys = []
    for t, (i, j) in enumerate(combinations(range(n), 2)):
        wj = cuts[j + 1] - cuts[j]
        both = F.shiftleft(_part(fp, cuts[i], cuts[i + 1] - cuts[i]), wj).bitwiseOR(_part(fp, cuts[j], wj))
        keys.append(F.struct(F.lit(t).alias("t"), both.alias("k")))
    return F.array(*keys)


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, blocks): word [b, j] has bit b of the 64 fingerprints of block j."""
    lanes = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def _exceed(ones: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (bit-sliced, least first) is above radius, or has overflowed."""
    above, equal = np.zeros_like(over), np.full_like(over, FULL)
    for i in reversed(range(len(ones))):
        if radius >> i & 1:
            equal &= ones[i]
        else:
            above |= equal & ones[i]
            equal &= ~ones[i]
    return above | over


def close_pairs(fps: np.ndarray, blocks: np.ndarray, queries: np.ndarray, radius: int, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, other) at most `radius` bits apart; row i compares queries[i] with block blocks[i].

    One bit plane at a time, 64 distances move at once in carry-save counters; a row whose
    64 lanes have all passed the radius is abandoned.
    """
    n, depth = len(fps), (radius + 1).bit_length()
    lane = queries - blocks * 64  # only later lanes count, so that a pair comes once
    over = np.where(lane < 0, np.uint64(0), np.where(lane >= 63, FULL, (np.uint64(2) << np.clip(lane, 0, 62).astype(np.uint64)) - np.uint64(1)))
    last = n - blocks * 64  # lanes past the end never count
    over |= np.where(last >= 64, np.uint64(0), ~((np.uint64(1) << np.clip(last, 0, 63).astype(np.uint64)) - np.uint64(1)))
    counts = [np.zeros(len(queries), dtype=np.uint64) for _ in range(depth)]
    mine = fps[queries]
    for b in range(BITS):
        carry = planes[b, blocks] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & np.uint64(1)))
        for c in counts:
            carried = c & carry
            c ^= carry
            carry = carried
        over |= carry
        if b % 8 == 7:
            live = _exceed(counts, over, radius) != FULL
            if live.sum() < 0.8 * len(live):
                blocks, queries, mine, over = blocks[live], queries[live], mine[live], over[live]
                counts = [c[live] for c in counts]
                if not len(queries):
                    break
    near = ~_exceed(counts, over, radius)
    hit = np.flatnonzero(near)
    bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return queries[hit][row], blocks[hit][row] * 64 + lane


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining a[i] with b[i]; each label is the least index of its set."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp of its local root), at most one a row, that join whatever is close within a bucket.

    keys: bucket number of each row, rising. Rows of several small buckets may share a block:
    a close pair is a link whatever buckets it was met in.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    keep = np.repeat(sizes > 1, sizes)
    fps, sizes = fps[keep], sizes[sizes > 1]
    if not len(fps):
        return fps, fps
    planes, ends = _planes(fps), np.cumsum(sizes)
    first, last = np.arange(len(fps)) // 64, (np.repeat(ends, sizes) - 1) // 64
    reach = last - first + 1  # a row meets its own block and the later ones of its bucket
    labels = np.arange(len(fps))
    done = np.r_[0, np.cumsum(reach)]
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(done, done[at] + STEP, "right")) - 1)
        q = np.repeat(np.arange(at, to), reach[at:to])
        j = first[q] + (np.arange(len(q)) - (done[q] - done[at]))
        a, b = close_pairs(fps, j, q, radius, planes)
        labels = _hook(labels, a, b)
        at = to
    child = labels != np.arange(len(fps))
    return fps[child], fps[labels[child]]


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(all_of_it: bool) -> pa.RecordBatch | None:
            nonlocal held, rows
            b = np.concatenate([x for x, _ in held])
            f = np.concatenate([x for _, x in held])
            cut = len(b) if all_of_it else int(np.searchsorted(b, b[-1]))  # the last bucket may go on
            held, rows = ([] if all_of_it else [(b[cut:], f[cut:])]), len(b) - cut
            u, v = forest(b[:cut], f[:cut].view(np.uint64), radius) if cut else ((), ())
            return pa.RecordBatch.from_pydict({"u": np.asarray(u, np.uint64).view(np.int64), "v": np.asarray(v, np.uint64).view(np.int64)}) if len(u) else None

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= 4 * STEP and (out := flush(False)):
                yield out
        if held and (out := flush(True)):
            yield out

    return run


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp) at most `radius` bits apart.

    Rows are dealt by two agreeing parts of the fingerprint. A bucket above HOT_BUCKET distinct
    fingerprints is divided again by two agreeing parts of the bits outside its key, so the
    largest bucket holds no more than the values of the bits then left: nothing is capped.
    """
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    spans = {t: [(cuts[x], cuts[x + 1]) for x in range(n) if x not in p] for t, p in enumerate(combinations(range(n), 2))}
    rows = fps.select("fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("b")).select("fp", F.col("b.t").alias("t"), F.col("b.k").alias("k"))
    hot = materialize(rows.groupBy("t", "k").count().where(F.col("count") > HOT_BUCKET).select("t", "k"), "hot-buckets")
    if hot.isEmpty():
        dealt = rows.select(F.shiftleft(F.col("k"), 5).bitwiseOR(F.col("t")).alias("bucket"), "fp")
    else:
        marked = rows.join(hot.withColumn("hot", F.lit(True)), ["t", "k"], "left")
        cold = marked.where("hot IS NULL").select(F.xxhash64("t", "k").alias("bucket"), "fp")
        rest = F.lit(0).cast("long")  # the bits outside the bucket's key, packed; only the key is taken from them
        for t, parts in spans.items():
            packed = F.lit(0).cast("long")
            for low, high in parts:
                packed = F.shiftleft(packed, high - low).bitwiseOR(_part(F.col("fp"), low, high - low))
            rest = F.when(F.col("t") == t, packed).otherwise(rest)
        width = min(sum(high - low for low, high in parts) for parts in spans.values())
        deeper = marked.where("hot").withColumn("s", F.explode(bucket_keys(rest, radius, 0, width)))
        dealt = cold.unionByName(deeper.select(F.xxhash64("t", "k", "s").alias("bucket"), "fp"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link(radius), "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) of every row: a hash of its text, its fingerprint, and that of its group's root. See near_duplicates()."""
    with arrow_limits(docs.sparkSession):
        marked = materialize(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(fps.select("fp"), radius))
    linked = fps.join(roots.selectExpr("node AS fp", "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    comps = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(linked.join(materialize(comps, "components"), "root").select("fp", "root", "component_id"), "grouped-fingerprints")
    return marked.join(by_fp, "fp")  # read anew, so that a frequent fingerprint's rows can be split over tasks


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Fingerprints at most `radius` bits apart are linked; component_id is the smallest id that
    links reach. Null, empty and white-space texts have fingerprint zero and are linked like
    others. Rows that repeat an id all stay. Rows with a null id stay too; an id is null only
    for a component that has no other. An empty table gives no rows. Copies meet by a
    partial aggregation on their fingerprint before anything is compared. Other columns of
    docs, whatever their names, are not read.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups(docs, id_col, text_col, radius).select(F.col("doc_id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """The rows of docs without near duplicates: of each group the row of the least id, of its texts the one whose hash is least.

    Rows without an id stay only where a group has no other; of rows that repeat an id and a text one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    kept = groups(docs, id_col, text_col, radius).groupBy("root").agg(F.min(order).alias("k"))
    kept = materialize(kept.select(F.col("k.doc_id").alias("kept"), F.col("k.mark").alias("mark")), "kept-documents")
    row = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))  # the caller's names stay inside
    met = row.join(kept, F.col("id").eqNullSafe(F.col("kept")) & (F.col("own") == F.col("mark")))
    return met.withColumn("nth", F.row_number().over(Window.partitionBy("id", "own").orderBy(F.lit(0)))).where("nth = 1").select("row.*")
