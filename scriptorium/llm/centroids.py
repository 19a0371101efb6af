"""Centroid clustering over blocks of vectors in Hilbert order, each with a bounding box."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .topk import usable

#: Vectors of a block, bits of each coordinate on the curve, and the largest coordinate: four times its square over 64 coordinates still fits 63 bits.
BLOCK_ROWS, CURVE_BITS, MOST = 512, 4, 1 << 27
EXACT = 1 << 53


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; beyond MOST, MOST counts."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("long"), F.lit(MOST)), F.lit(-MOST)).cast("int"))


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of cells (bits a coordinate) on a Hilbert curve, as bytes that sort like it.

    Skilling's transform: from the highest bit down, each coordinate flips or swaps the lower
    bits of the first, then all are Gray-coded; the bits, plane by plane, are the place.
    """
    x = cells.astype(np.uint32).T.copy()
    for b in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for row in x:
            high = (row & q) != 0
            swap = np.where(high, 0, (x[0] ^ row) & p)
            x[0] ^= np.where(high, p, swap)
            row ^= np.where(high, 0, swap)  # for the first coordinate swap is zero
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << b), np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & 1 for b in reversed(range(bits))])  # (bits, dims, rows)
    packed = np.packbits(planes.reshape(-1, x.shape[1]).astype(np.uint8), axis=0).T.copy()
    return [row.tobytes() for row in packed]


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _block(ids: pa.Array, x: np.ndarray) -> dict:
    return {"ids": ids, "vectors": x.astype("<i4").tobytes(), "low": x.min(axis=0).astype("<i4").tobytes(), "high": x.max(axis=0).astype("<i4").tobytes()}


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """vectors (vec_id, vector array<int>) as a table of blocks (ids, vectors, low, high) of rows near each other on the curve.

    Ranges of the curve are dealt with a salt, so that equal vectors can be split over tasks.
    """
    low, high = vectors.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    kind = dict(vectors.dtypes)["vec_id"]
    span = max(1, (high or 0) - (low or 0) + 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (_matrix(batch.column(2), dims).astype(np.int64) - low) * (1 << CURVE_BITS) // span
            yield pa.RecordBatch.from_arrays([pa.array(hilbert_keys(cells, CURVE_BITS), pa.binary()), *batch.columns], names=["place", *batch.schema.names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            left = now if left is None else pa.concat_tables([left, now])
            whole = left.num_rows // BLOCK_ROWS * BLOCK_ROWS
            if whole:
                yield made(left.slice(0, whole))
                left = left.slice(whole)
        if left is not None and left.num_rows:
            yield made(left)

    def made(rows: pa.Table) -> pa.RecordBatch:
        found = []
        for at in range(0, rows.num_rows, BLOCK_ROWS):
            some = rows.slice(at, BLOCK_ROWS).combine_chunks()
            found.append(_block(some["vec_id"].to_pylist(), _matrix(some["vector"].chunk(0), dims)))
        return pa.RecordBatch.from_pylist(found, schema=pa.schema([("ids", pa.list_(rows.schema.field("vec_id").type)), *((n, pa.binary()) for n in ("vectors", "low", "high"))]))

    salted = vectors.select(F.xxhash64(F.monotonically_increasing_id()).alias("salt"), "vec_id", "vector")
    ordered = salted.mapInArrow(placed, f"place binary, salt long, vec_id {kind}, vector array<int>").repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")
    return materialize(ordered.select("vec_id", "vector").mapInArrow(cut, f"ids array<{kind}>, vectors binary, low binary, high binary"), "hilbert-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some vector of the box: nearer at best than some centroid is at worst."""
    below, above = centroids - low, centroids - high
    least = np.maximum(np.maximum(-below, above), 0)
    most = np.maximum(np.abs(below), np.abs(above))
    return np.flatnonzero((least * least).sum(axis=1) <= (most * most).sum(axis=1).min())


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centroid, the first of several; squared distance) of each row of x, exactly."""
    peak = int(max(np.abs(x).max(), np.abs(centroids).max()))
    kind = np.float64 if 4 * x.shape[1] * peak * peak < EXACT else np.int64  # doubles hold these integers exactly
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best].astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, cluster, distance) of each block."""
    dims = centroids.shape[1]
    for batch in batches:
        for row in range(batch.num_rows):
            x, low, high = (np.frombuffer(batch.column(i)[row].as_py(), "<i4").astype(np.int64) for i in (1, 2, 3))
            near = candidates(low, high, centroids)
            best, distance = assigned(x.reshape(-1, dims), centroids[near])
            yield batch.column(0)[row].values, x.reshape(-1, dims), near[best], distance


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floors of exact means; those without vectors stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, x, cluster, _ in _each(batches, centroids):
            order = np.argsort(cluster, kind="stable")
            at, start = np.unique(cluster[order], return_index=True)
            total[at] += np.add.reduceat(x[order], start, axis=0)
            count += np.bincount(cluster, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some], pa.int64()), "sums": pa.array(list(total[some]), pa.list_(pa.int64()))})

    parts = table.mapInArrow(sums, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("d", "x"))
    rows = parts.groupBy("cluster", "d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()  # a row a centroid and dimension
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.d] = int(r.x) // r.n
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of vectors (vec_id, vector array<int> of `dims`), and the final centroids.

    Starts from the k vectors whose lower-case SHA-256 of `seed:vec_id` is least (of equal ids
    the least vector first, null ids last; all vectors where there are fewer), moves them
    `rounds` times and assigns once more. Distances are exact, ties go to the smaller number.
    """
    spark = vectors.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "vector").limit(k).select("vector").collect()  # k rows
    if not first:
        return spark.createDataFrame([], vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema), np.zeros((0, dims), np.int64)
    centroids = np.array([r.vector for r in first], np.int64)
    table = blocks(vectors, dims)
    for _ in range(rounds):
        centroids = _moved(table, centroids)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _each(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = dict(vectors.dtypes)["vec_id"]
    return materialize(table.mapInArrow(told, f"vec_id {kind}, cluster int, distance long"), "clusters", table), centroids


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of exactly `dims` components.

    Rows whose vector is null, of another length, or holds a null or a component that isn't
    finite take no part. Rows that repeat an id or a vector all count; rows without an id are
    clustered too, but no cluster starts from them while others are left. An empty table gives no
    rows. Inertias are exact; one beyond a long is null. Other columns are not read.
    """
    spark = rows.sparkSession
    kept = rows.where((F.size(F.col(vector_col)) == dims) & usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), quantized(F.col(vector_col)).alias("vector"))
    found, centroids = clusters(kept, k, rounds, dims)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    long = lambda x: x if x < 1 << 63 else None
    told = [(c, long(s), long(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    sides = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sides), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
