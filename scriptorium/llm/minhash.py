"""Near duplicates by word shingles: HyperMinHash sketches, banding, estimate, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize
from .graph import connected_components

#: Words of a shingle, and the similarity from which documents are linked, in hundredths.
WIDTH, LEAST = 4, 80
#: Registers of a sketch (a power of two), bits of mantissa kept in each, bands and registers of a band.
REGISTERS, MANTISSA, BANDS, ROWS = 256, 10, 42, 6
#: Sets of at least this size are told apart by their sketches first. MARGIN: how far below LEAST an estimate rules a pair out, five standard errors.
SKETCHED, MARGIN = 256, 0.15
#: Members up to which a bucket's open pairs are listed; larger buckets meet in tiles of about so many members and elements.
LISTED, TILE_ROWS, TILE_ELEMENTS = 32, 1024, 1 << 20
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
SEED = 7

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: _RANK[j, b]: the place of bucket b among those that register j borrows from; its own comes first.
_RANK = np.argsort(np.argsort(_RNG.random((REGISTERS, REGISTERS)) + 1.0 - 2.0 * np.eye(REGISTERS), axis=1), axis=1).astype(np.uint8)


class _Words(dict):
    """word: hash of a word, for words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: dict[bytes, int]) -> np.ndarray:
    """The rising 64-bit hashes of a text's distinct shingles; fewer words than a shingle's make one, none make none."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED + len(found))], np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = len(w) - WIDTH + 1
    total = w[:n] * _FACTORS[0]
    for i in range(1, WIDTH):
        total += w[i : i + n] * _FACTORS[i]
    return np.unique(_mixed(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set that isn't empty.

    A hash's top bits choose a bucket; the bucket keeps its least hash as the number of leading
    zeros and the bits after the first one. A bucket that no hash falls into borrows from the
    first filled one in an order of its own, the same for all sets, so that any two registers
    agree with about the sets' similarity, however small the sets are.
    """
    bits = REGISTERS.bit_length() - 1
    bucket, rest = (hashes >> np.uint64(64 - bits)).astype(np.int64), hashes << np.uint64(bits)
    filled, first = np.unique(bucket, return_index=True)  # hashes rise, so the first of a bucket is its least
    low = rest[first] | np.uint64(1)
    zeros = 63 - np.floor(np.log2(low.astype(np.float64))).astype(np.int64)
    over = (low >> (np.uint64(63) - np.clip(zeros, 0, 63).astype(np.uint64))) == 0  # rounding up to a power of two
    zeros += over
    mantissa = ((low << zeros.astype(np.uint64)) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    kept = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return kept[_RANK[:, filled].argmin(axis=1)]


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its number and registers."""
    out = np.empty(BANDS, np.uint64)
    for b in range(BANDS):
        out[b] = xxhash.xxh3_64_intdigest(registers[b * ROWS : (b + 1) * ROWS].tobytes(), b)
    return out.view(np.int64)


SKETCH = "doc_id {id}, mark long, hi long, lo long, n long, registers binary, bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        hi, lo, n, registers, bands = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            s = shingle_set(text, words)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            hi.append(int.from_bytes(digest[:8], "big", signed=True))
            lo.append(int.from_bytes(digest[8:], "big", signed=True))
            n.append(len(s))
            own = sketch(s) if len(s) else None
            registers.append(own.tobytes() if len(s) else None)
            bands.append(band_keys(own) if len(s) > 3 else [])  # smaller sets are like equal ones only
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (hi, lo, n)), pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "mark", "hi", "lo", "n", "registers", "bands"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["no", "hashes"])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities by registers (rows of a and b) of sets of n and m elements.

    Registers of unlike elements agree by chance with the rate that the HyperMinHash paper gives
    for the compression, which is taken off.
    """
    ratio = np.maximum(n, m) / np.minimum(n, m)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0.0, ((a == b).mean(axis=1) - chance) / (1 - chance))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, n, m, a, b) whose sketches don't rule them out, as (u, v)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, m = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 3))
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
        keep = (np.minimum(n, m) < SKETCHED) | (estimate(a, b, n, m) >= LEAST / 100 - MARGIN)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["u", "v"])


def _enough(common: Column, n: Column, m: Column) -> Column:
    return 100 * common >= LEAST * (n + m - common)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, no) sorted by both to (key, u, v): the least no of a key with each of the others."""
    key, centre = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, no = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = np.r_[key is None or k[0] != key, k[1:] != k[:-1]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(k)), -1))
        u = np.where(at >= 0, no[np.maximum(at, 0)], centre if centre is not None else -1)
        key, centre = k[-1], u[-1]
        yield pa.RecordBatch.from_pydict({"key": k[~start], "u": u[~start], "v": no[~start]})


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (members, roots) of small buckets to their pairs (u, v) of different roots, without those of the first member, which have been looked at."""
    for batch in batches:
        us, vs = [], []
        for members, roots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            no, root = np.array(members, np.int64), np.array(roots, np.int64)
            i, j = np.nonzero(np.triu(root[:, None] != root[None, :], 1))
            us.append(no[i])
            vs.append(no[j])
        yield pa.RecordBatch.from_pydict({"u": np.concatenate(us) if us else np.zeros(0, np.int64), "v": np.concatenate(vs) if vs else np.zeros(0, np.int64)})


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets left with sets right, as products of 0/1 matrices over the elements that several sets hold."""
    sizes = np.array([len(s) for s in sets])
    row, element = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, code, count = np.unique(element, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    row, code = row[keep], (np.cumsum(count > 1) - 1)[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        lo, hi = np.searchsorted(code, [at, at + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[row[lo:hi], code[lo:hi] - at] = 1
        out += x[left] @ x[right].T
    return out


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """Links between the members of two parts of a large bucket, at most one for each root that joins another."""
    i, j = (k.as_py() for k in key[1:])
    no, root, part = (table[c].to_numpy() for c in ("no", "root", "part"))
    held = table["hashes"].combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    ends = held.value_lengths().to_numpy().cumsum()
    sets = np.split(held.flatten().to_numpy(), ends[:-1])
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    if not len(left) or not len(right) or len(np.unique(root)) < 2:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    sizes = np.array([len(s) for s in sets], np.float64)
    common = _common(sets, left, right).astype(np.float64)
    a, b = np.nonzero((100 * common >= LEAST * (sizes[left][:, None] + sizes[right][None, :] - common)) & (root[left][:, None] != root[right][None, :]))
    joined: dict[int, int] = {}

    def find(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    links = []
    for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
        p, q = find(int(root[x])), find(int(root[y]))
        if p != q:
            joined[p] = q
            links.append((int(no[x]), int(no[y])))
    return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})


def classes_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each document's id, set digest and size; each distinct set that isn't empty once, with a number, its least document and its sketch."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    rows = materialize(arrow_batches(narrow, _sketched, SKETCH.format(id=dict(narrow.dtypes)["doc_id"]), rows=500), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    met = rows.where("n > 0").groupBy("hi", "lo").agg(first.alias("first"), F.max("n").alias("n"), F.max("registers").alias("registers"), F.max("bands").alias("bands"))
    return rows, materialize(met.select("hi", "lo", F.col("first.doc_id").alias("least"), F.col("first.mark").alias("mark"), "n", "registers", "bands", F.monotonically_increasing_id().alias("no")), "classes")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, component_id) of every row; see near_duplicates()."""
    rows, classes = classes_of(docs, id_col, text_col)
    keys = classes.select(F.explode("bands").alias("key"), "no")
    stars = materialize(keys.repartition("key").sortWithinPartitions("key", "no").mapInArrow(_stars, "key long, u long, v long"), "buckets")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    spent = [stars]

    def kept(df: DataFrame, name: str) -> DataFrame:
        spent.append(materialize(df, name))
        return spent[-1]

    def sets(wanted: DataFrame) -> DataFrame:
        """(no, hashes) of the classes wanted: the text of each one's first document is cut once more."""
        of = classes.join(wanted, "no", "left_semi").select("no", "least", "mark")
        found = texts.join(of, texts["id"].eqNullSafe(of["least"]) & (texts["own"] == of["mark"])).groupBy("no").agg(F.max("text").alias("text"))
        return kept(arrow_batches(found, _hashed, "no long, hashes array<long>", rows=500), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs (u, v) of classes whose sets are alike: sizes first, then sketches, then the whole sets."""
        known = classes.select("no", "n", "registers")
        met = pairs.join(known.select(F.col("no").alias("u"), "n", F.col("registers").alias("a")), "u")
        met = met.join(known.select(F.col("no").alias("v"), F.col("n").alias("m"), F.col("registers").alias("b")), "v").where(_enough(F.least("n", "m"), F.col("n"), F.col("m")))
        near = kept(arrow_batches(met.select("u", "v", "n", "m", "a", "b"), _alike, "u long, v long"), "alike")
        held = sets(near.select(F.explode(F.array("u", "v")).alias("no")).distinct())
        full = near.join(held.select(F.col("no").alias("u"), F.col("hashes").alias("a")), "u").join(held.select(F.col("no").alias("v"), F.col("hashes").alias("b")), "v")
        return kept(full.where(_enough(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select("u", "v"), "links")

    first = confirmed(stars.select("u", "v").distinct())
    roots = kept(connected_components(first), "roots")
    of_v = stars.join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left").select("key", "u", "v", F.coalesce("rv", "v").alias("rv"))
    placed = kept(of_v.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").select("key", "u", "v", "rv", F.coalesce("ru", "u").alias("ru")), "placed")
    # the first of a bucket has met all others; of those, only different roots can still be linked
    open_ = kept(placed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("rv").alias("low"), F.max("rv").alias("high")).where("low <> high").select("key", "k"), "open-buckets")
    members = placed.join(open_, "key").select("key", "k", F.col("v").alias("no"), F.col("rv").alias("root"))
    listed = members.where(F.col("k") <= LISTED).groupBy("key").agg(F.collect_list(F.struct("no", "root")).alias("m")).select("m.no", "m.root")
    links = first.unionByName(confirmed(listed.mapInArrow(_open_pairs, "u long, v long").distinct()))
    large = kept(members.where(F.col("k") > LISTED).select("key", "no", "root"), "large-buckets")
    if not large.isEmpty():
        links = links.unionByName(kept(_tiled(large, classes, sets(large.select("no").distinct())), "links-of-tiles"))
    linked = connected_components(links)
    numbered = classes.select("no", "hi", "lo", "least").join(linked.select(F.col("node").alias("no"), "root"), "no", "left").withColumn("root", F.coalesce("root", "no"))
    comps = kept(numbered.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    told = materialize(numbered.join(comps, "root").select("hi", "lo", "component_id"), "class-components", *spent, classes)
    met = rows.where("n > 0").join(told, ["hi", "lo"]).select("doc_id", "n", "component_id")  # both read anew, so that a frequent set's rows can be split over tasks
    return met.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def _tiled(large: DataFrame, classes: DataFrame, held: DataFrame) -> DataFrame:
    """Links between different roots within large buckets. Their members are dealt into parts, and each two parts meet in a group of their own."""
    sized = large.join(classes.select("no", "n"), "no")
    parts = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") / TILE_ELEMENTS)).cast("int").alias("parts"))
    dealt = large.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j"))))
    tiles = dealt.withColumn("t", meets).select("key", "t.i", "t.j", "part", "no", "root")
    return tiles.join(held, "no").groupBy("key", "i", "j").applyInArrow(_tile, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles (distinct shingles of WIDTH words), component_id, kept.

    Documents whose sets have a similarity of LEAST hundredths or more are linked; component_id is
    the smallest id that links reach, and kept tells whether that is the row's own. Words are cut at
    ASCII white space, A-Z lower-cased. A text of fewer words is one shingle; null, empty and
    white-space texts have none and are linked with nothing, so they keep their own id. Rows that
    repeat an id or a text all stay, as do rows with a null id: their component's id is null only
    if no linked row has one, and they are kept then. An empty table gives no rows; other columns,
    whatever their names, are not read.

    Equal sets are one class. Sketches of classes are cut into BANDS bands of ROWS registers; a
    pair at the least similarity misses all of them with a probability of 3 in a million. In each
    bucket the first member is checked against all others. What stays apart is checked again: pair
    by pair in small buckets, in tiles of two parts a task in large ones, without leaving any out.
    """
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return groups(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", same.alias("kept"))
