"""Exact top-k inner-product search over paged metric trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Rows of one tree, of one leaf page, children of an inner node, pivots at most, and rows of the sample that pivots are chosen from.
TREE_ROWS, PAGE_ROWS, FANOUT, MOST_PIVOTS, SAMPLE = 2048, 64, 8, 1024, 8192
#: Queries that are sent to all tasks at a time (about these bytes of vectors), and those that go through a tree together.
QUERY_BYTES, QUERY_BATCH = 32 << 20, 4096
#: Entries of trees that a task holds at a time.
FOREST_BYTES = 64 << 20
EXACT = float(1 << 53)


def quantized(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    lengths, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _lifted(x: np.ndarray, peak: int) -> np.ndarray:
    """x with the coordinate that gives every row the norm of the longest: nearest is then the highest inner product."""
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(0.0, peak - (x * x).sum(axis=1)))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to n rows, each the farthest from those before it."""
    chosen, far = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[chosen[-1:]])[:, 0])
    return np.array(chosen)


#: One tree a row. Nodes are numbered from the root down; an entry of `first` is a node's first child, or -1 - the first row of a leaf page.
TREE = T.StructType([T.StructField("pivot", T.IntegerType())] + [T.StructField(x, T.BinaryType()) for x in ("centres", "radius", "to_parent", "first", "count", "ids", "vectors", "to_centre")])


def plant(ids: np.ndarray, vectors: np.ndarray, peak: int) -> dict[str, np.ndarray]:
    """A metric tree of rows: nodes with centre, covering radius and distance to the parent, split while they exceed a page.

    Leaf pages hold their rows by distance to the page's centre, and that distance.
    """
    x = _lifted(vectors, peak)
    centres, radius, to_parent, first, count = [], [], [], [], []
    rows: list[np.ndarray] = []
    far: list[np.ndarray] = []
    placed = 0
    level: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(x)), None)]
    while level:
        below: list[tuple[np.ndarray, np.ndarray | None]] = []
        start = len(centres) + len(level)  # number of the first node of the next level
        for members, parent in level:
            centre = x[members].mean(axis=0, keepdims=True)
            d = _distances(x[members], centre)[:, 0]
            centres.append(centre[0])
            radius.append(float(d.max()))
            to_parent.append(0.0 if parent is None else float(_distances(centre, parent)[0, 0]))
            if len(members) <= PAGE_ROWS:
                order = np.argsort(d, kind="stable")
                rows.append(members[order])
                far.append(d[order])
                first.append(-1 - placed)
                count.append(len(members))
                placed += len(members)
                continue
            seeds = _spread(x[members], min(FANOUT, -(-len(members) // PAGE_ROWS)))
            nearest = _distances(x[members], x[members[seeds]]).argmin(axis=1)
            parts = [members[nearest == s] for s in range(len(seeds))]
            parts = [p for p in parts if len(p)]
            if len(parts) == 1:  # rows that can't be told apart are cut by number
                parts = np.array_split(members, min(FANOUT, -(-len(members) // PAGE_ROWS)))
            first.append(start + len(below))
            count.append(len(parts))
            below += [(p, centre) for p in parts]
        level = below
    order = np.concatenate(rows)
    return {
        "centres": np.stack(centres), "radius": np.array(radius), "to_parent": np.array(to_parent), "first": np.array(first, np.int64), "count": np.array(count, np.int64),
        "ids": ids[order], "vectors": vectors[order], "to_centre": np.concatenate(far),
    }


def _grow(dims: int, peak: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        tree = plant(rows["vec_id"].to_numpy().astype(np.int64), _matrix(rows["vector"].chunk(0), dims), peak)
        return pa.table({"pivot": pa.array([rows["pivot"][0].as_py()], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in tree.items()})

    return run


@dataclass
class Tree:
    pivot: int
    centres: np.ndarray
    radius: np.ndarray
    to_parent: np.ndarray
    first: np.ndarray
    count: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray  # float64 where that is exact
    to_centre: np.ndarray

    @classmethod
    def read(cls, row: dict, dims: int, exact: bool) -> Tree:
        f64, i64 = (lambda x: np.frombuffer(row[x], np.float64)), (lambda x: np.frombuffer(row[x], np.int64))
        vectors = i64("vectors").reshape(-1, dims)
        return cls(row["pivot"], f64("centres").reshape(-1, dims + 1), f64("radius"), f64("to_parent"), i64("first"), i64("count"), i64("ids"), vectors.astype(np.float64) if exact else vectors, f64("to_centre"))


class Best:
    """The k best (score, smaller id first) that each query of a batch has met."""

    def __init__(self, n: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors.copy()  # least score that may still be among the k best
        self.peaks = np.full((n, k), -np.inf)  # the k highest scores met
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of queries, a column for each of ids."""
        good = scores >= self.floors[queries, None]
        hot = np.flatnonzero(good.any(axis=1))
        if not len(hot):
            return
        some, good = queries[hot], good[hot]
        row, column = np.nonzero(good)
        self.held.append((some[row], scores[hot[row], column], ids[column]))
        self.size += len(row)
        both = np.concatenate([self.peaks[some], np.where(good, scores[hot], -np.inf)], axis=1)
        self.peaks[some] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.floors[some] = np.maximum(self.floors[some], self.peaks[some].min(axis=1))
        if self.size > 4 * self.peaks.size + 65_536:
            self.held = [self.result()]
            self.size = len(self.held[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id), at most k rows a query."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        q, s, i = (np.concatenate(x) for x in zip(*self.held, strict=True))
        near = s >= self.floors[q]
        q, s, i = q[near], s[near], i[near]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        keep = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < self.k
        return q[keep], s[keep], i[keep]


def search(trees: list[Tree], queries: np.ndarray, best: Best, peak: int, homes: np.ndarray | None = None) -> None:
    """Best-first over the nodes of all trees for a batch of queries at once.

    A node waits under the least distance that it may hold for any of the queries that can't
    rule it out yet. Bounds from stored distances to the parent come before distances to
    centres, those before scores. homes: pivots of the only trees that each query looks into.
    """
    q = np.c_[queries.astype(np.float64), np.zeros(len(queries))]
    norms = (q * q).sum(axis=1)

    def reach(some: np.ndarray) -> np.ndarray:
        # scores are whole, so the next lower one is 2 further in squared distance; less than that spares rounding
        return np.sqrt(np.maximum(0.0, norms[some] + peak - 2.0 * best.floors[some]) + 1.0 + 1e-6 * peak)

    heap: list[tuple] = []
    serial = 0

    def push(tree: Tree, node: int, some: np.ndarray, d: np.ndarray) -> None:
        nonlocal serial
        low = np.maximum(0.0, d - tree.radius[node])
        live = low <= reach(some)
        if live.any():
            serial += 1
            heapq.heappush(heap, (float(low[live].min()), serial, tree, node, some[live], d[live]))

    for tree in trees:
        some = np.arange(len(q)) if homes is None else np.flatnonzero(homes == tree.pivot)
        if len(some):
            push(tree, 0, some, _distances(q[some], tree.centres[:1])[:, 0])
    while heap:
        _, _, tree, node, some, d = heapq.heappop(heap)
        limit = reach(some)
        live = d - tree.radius[node] <= limit
        some, d, limit = some[live], d[live], limit[live]
        if not len(some):
            continue
        first, count = int(tree.first[node]), int(tree.count[node])
        if first < 0:
            far = tree.to_centre[-1 - first : -1 - first + count]
            a, b = np.searchsorted(far, (d - limit).min(), "left"), np.searchsorted(far, (d + limit).max(), "right")
            if a < b:
                at = slice(-1 - first + a, -1 - first + b)
                scores = q[some, :-1] @ tree.vectors[at].T if tree.vectors.dtype == np.float64 else (queries[some] @ tree.vectors[at].T).astype(np.float64)
                best.add(some, scores, tree.ids[at])
            continue
        children = np.arange(first, first + count)
        may = np.abs(d[:, None] - tree.to_parent[children]) - tree.radius[children] <= limit[:, None]
        for child in children[may.any(axis=0)].tolist():
            close = np.flatnonzero(may[:, child - first])
            push(tree, child, some[close], _distances(q[some[close]], tree.centres[child : child + 1])[:, 0])


FOUND = "query long, vec_id long, score long"


def _ask(queries, dims: int, peak: int, k: int, at_home: bool):
    """queries: broadcast (numbers, vectors, home pivots, floors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, homes, floors = queries.value
        floors = floors.copy()
        exact = float(peak) < EXACT / 4 and float((vectors.astype(np.float64) ** 2).sum(axis=1).max()) < EXACT / 4

        def ask(trees: list[Tree]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ids), QUERY_BATCH):
                some = slice(at, at + QUERY_BATCH)
                best = Best(len(ids[some]), k, floors[some])
                search(trees, vectors[some], best, peak, homes[some] if at_home else None)
                floors[some] = best.floors
                q, s, i = best.result()
                if len(q):
                    yield pa.RecordBatch.from_pydict({"query": ids[some][q], "vec_id": i, "score": s.astype(np.int64)})

        trees: list[Tree] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                trees.append(Tree.read(row, dims, exact))
                held += len(row["vectors"])
                if held >= FOREST_BYTES:
                    yield from ask(trees)
                    trees, held = [], 0
        if trees:
            yield from ask(trees)

    return run


def _cut(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build_index(vectors: DataFrame) -> tuple[DataFrame, np.ndarray, int, int] | None:
    """(trees, pivots, dims, peak) of vectors (vec_id, vector array<long>); None for an empty table.

    Every row is indexed. Pivots come from a sample of SAMPLE rows by hash; a row goes to its
    nearest pivot, and a pivot above TREE_ROWS rows is dealt over several trees by the place
    where a row was read, so no group grows with the data, even if all rows are alike.
    """
    spark = vectors.sparkSession
    dims, peak, n = vectors.agg(F.max(F.size("vector")), F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x)), F.count(F.lit(1))).first()
    if not n:
        return None
    dims, peak = max(1, dims), int(peak or 0)
    lowest = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    lifted = _lifted(_matrix(lowest if isinstance(lowest, pa.ListArray) else lowest.chunk(0), dims), peak)
    pivots = lifted[_spread(lifted, min(MOST_PIVOTS, max(1, -(-n // TREE_ROWS))))]
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = _distances(_lifted(_matrix(batch.column(2), dims), peak), shared.value).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(pivot), *batch.columns], names=["pivot", *batch.schema.names])

    dealt = vectors.select(F.xxhash64(F.monotonically_increasing_id()).alias("place"), "vec_id", "vector").mapInArrow(nearest, "pivot int, place long, vec_id long, vector array<long>")
    dealt = materialize(dealt, "vectors-by-pivot")
    sizes = dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).alias("trees"))
    salted = dealt.join(F.broadcast(sizes), "pivot").select("pivot", F.pmod("place", "trees").alias("salt"), "vec_id", "vector")  # at most MOST_PIVOTS rows are broadcast
    parts = min(n // TREE_ROWS + 1, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    trees = salted.repartition(parts, "pivot", "salt").groupBy("pivot", "salt").applyInArrow(_grow(dims, peak), TREE)
    return materialize(trees, "metric-trees"), pivots, dims, peak


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, smaller vec_id first on ties.

    vectors and queries: (vec_id long, vector array<long>), queries being rows of vectors. A query's
    candidates are all rows but its own; a query with fewer candidates than k gets them all. Rows
    that repeat an id or a vector are all candidates and, among queries, all asked: then an id has
    several lists. Shorter vectors are filled up with zeros. Rows with a null id or vector take
    no part; an empty table gives no rows. Other columns are not read.

    Queries go out in blocks of about QUERY_BYTES, and k + 1 rows are searched for: of those that
    have a query's id and its product with itself, one is the query. A first pass looks only into
    each query's home trees; the last score found there is a floor for the pass over all trees.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "vector").where("vec_id IS NOT NULL AND vector IS NOT NULL")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    built = build_index(vectors)
    if built is None:
        return none
    trees, pivots, dims, peak = built
    own = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x)
    asked = queries.where("vec_id IS NOT NULL AND vector IS NOT NULL").select(F.monotonically_increasing_id().alias("query"), "vec_id", "vector", own.alias("own"))
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() * 8 * dims // QUERY_BYTES))
    results = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        rows = block.select("query", "vector").toArrow().combine_chunks()  # about QUERY_BYTES
        if not rows.num_rows:
            continue
        ids, mine = rows["query"].to_numpy().astype(np.int64), _matrix(rows["vector"].chunk(0), dims)
        homes = _distances(np.c_[mine.astype(np.float64), np.zeros(len(mine))], pivots).argmin(axis=1)
        first = spark.sparkContext.broadcast((ids, mine, homes, np.full(len(ids), -np.inf)))
        near = _cut(trees.mapInArrow(_ask(first, dims, peak, k + 1, True), FOUND), k + 1)
        floors = {r.query: float(r.score) for r in near.where(F.col("rank") == k + 1).select("query", "score").collect()}  # a row a query of the block
        second = spark.sparkContext.broadcast((ids, mine, homes, np.array([floors.get(i, -np.inf) for i in ids.tolist()])))
        best = _cut(trees.mapInArrow(_ask(second, dims, peak, k + 1, False), FOUND), k + 1).join(block.select("query", F.col("vec_id").alias("query_id"), "own"), "query")
        self_at = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(Window.partitionBy("query"))
        best = best.withColumn("self", F.coalesce(self_at, F.lit(k + 2))).where("rank <> self").withColumn("rank", F.col("rank") - (F.col("rank") > F.col("self")).cast("int")).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", "vec_id", "score")
        results.append(materialize(best, "top-k") if blocks > 1 else best)
    out = results[0] if results else none
    for more in results[1:]:
        out = out.unionByName(more)
    return out
