"""Exact top-k inner-product search with a KD-tree in each shard.

Median splits of a bounded sample cut space into regions; each region's vectors lie in shards of a bounded size, and each shard's tree is built once by median splits along the widest side, with tight
bounding boxes, and written to the shared folder. A box bounds the inner products of its vectors by the sum over components of the larger of q*low and q*high. Queries visit regions best-first in
rounds, the best one, then the next three, twelve and so on; after each round the k-th score so far is propagated, and a query goes to no region whose box cannot beat it. Within a tree the visit is best-first
too and ends where the best box left cannot beat the k-th score.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import cut, drop_cut

#: Rows of a shard, of a tree's leaf and of a block of queries, on average; blocks of queries that meet one tree at a time.
SHARD, LEAF, BLOCK, BLOCKS = 8192, 128, 512, 8
#: Vectors of the sample that places the splits (those with the smallest hash of their ids; every vector is then placed), and regions at most, which bounds the boxes that tasks hold.
SAMPLE, REGIONS = 16_384, 4096
#: How many times more regions each round visits than the one before.
GROWTH = 3


class KDTree:
    """A balanced tree over integer vectors: nodes hold the range of their rows, their box and their first child (-1: a leaf)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        ranges, child, low, high = [(0, len(ids))], [-1], [], []
        at = 0
        while at < len(ranges):
            a, b = ranges[at]
            rows = vectors[order[a:b]]
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            low.append(lo)
            high.append(hi)
            if b - a > leaf and (hi > lo).any():
                dim, mid = int(np.argmax(hi - lo)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, dim], mid)]
                child[at] = len(ranges)
                ranges += [(a, a + mid), (a + mid, b)]
                child += [-1, -1]
            at += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.ranges, self.child = np.array(ranges), np.array(child)
        self.low, self.high = np.array(low), np.array(high)

    PARTS = ("ids", "vectors", "ranges", "child", "low", "high")

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> KDTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            for n in cls.PARTS:
                setattr(tree, n, parts[n])
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray):
        """For each query the (score, id) of its best k rows but its own; rows below the query's floor may be left out.

        A box whose bound equals the k-th score is still visited, as a tie may have a smaller id.
        """
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = _products(up, self.high) + _products(down, self.low)
        child, ranges = self.child.tolist(), self.ranges.tolist()
        for i in range(len(queries)):
            bound, best, floor = bounds[i], [], int(floors[i])  # best: a heap of (score, -id)
            heap = [(-int(bound[0]), 0)]
            while heap:
                negative, node = heapq.heappop(heap)
                if -negative < floor:
                    break
                first = child[node]
                if first >= 0:
                    for c in (first, first + 1):
                        if bound[c] >= floor:
                            heapq.heappush(heap, (-int(bound[c]), c))
                    continue
                a, b = ranges[node]
                ids, scores = self.ids[a:b], _products(queries[i : i + 1], self.vectors[a:b])[0]
                near = np.flatnonzero((scores >= floor) & (ids != own[i]))
                if len(near) > k:
                    near = near[np.lexsort((ids[near], -scores[near]))[:k]]
                for s, v in zip(scores[near].tolist(), ids[near].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    elif (s, -v) > best[0]:
                        heapq.heapreplace(best, (s, -v))
                if len(best) == k:
                    floor = max(floor, best[0][0])
            yield sorted(((s, -v) for s, v in best), key=lambda x: (-x[0], x[1]))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in double precision where no sum can leave its whole numbers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * component) as array<long>; rows with a null id, a null vector or null or non-finite components are left out, and empty vectors."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0").filter(~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


class Splits:
    """A balanced tree of median splits of a sample: regions are numbered from the left."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth if len(sample) else 0
        self.dims, self.limits = np.zeros(1 << self.depth, dtype=np.int64), np.zeros(1 << self.depth, dtype=np.int64)  # by node, the root is 1
        rows = {1: sample}
        for node in range(1, 1 << self.depth):
            x = rows.pop(node)
            if len(x):
                self.dims[node] = d = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                self.limits[node] = limit = int(np.partition(x[:, d], len(x) // 2)[len(x) // 2])
                left = x[:, d] < limit
                rows[2 * node], rows[2 * node + 1] = x[left], x[~left]
            else:
                rows[2 * node] = rows[2 * node + 1] = x

    def regions(self, vectors: np.ndarray) -> np.ndarray:
        node = np.ones(len(vectors), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (vectors[np.arange(len(vectors)), self.dims[node]] >= self.limits[node])
        return node - (1 << self.depth)


def _by_dimension(column):
    """(dimension, rows, matrix) of the arrays in a column."""
    sizes = np.array([len(x) for x in column], dtype=np.int64)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, _matrix(column.take(pa.array(rows)))


def _placed(rows: DataFrame, splits: Splits, dim: int) -> DataFrame:
    """rows (vec_id, v) with dim and region; vectors of another dimension than the commonest all lie in its region 0."""

    def run(batches):
        for b in batches:
            region, dims = np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows, dtype=np.int32)
            for d, at, x in _by_dimension(b.column(1)):
                dims[at] = d
                if d == dim:
                    region[at] = splits.regions(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(region)], ["vec_id", "v", "dim", "region"])

    return cut(rows.mapInArrow(run, "vec_id long, v array<long>, dim int, region int"))


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _products(np.maximum(queries, 0), high) + _products(np.minimum(queries, 0), low)


def _routed(asked: DataFrame, boxes: dict, first: int, last: int | None) -> DataFrame:
    """asked (vec_id, v, floor) with dim and a row for each region that the query has among its best ones from first to last, if the region's box may beat the floor."""

    def run(batches):
        for b in batches:
            floors, rows, dims, regions = b.column(2).to_numpy(zero_copy_only=False), [], [], []
            for d, at, x in _by_dimension(b.column(1)):
                if d not in boxes:
                    continue
                names, low, high = boxes[d]
                bound = _bounds(x, low, high)
                # of equal bounds the region with the smaller number is better
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                good = np.take_along_axis(bound, order, axis=1) >= floors[at, None]
                i, j = np.nonzero(good)
                rows.append(at[i])
                dims.append(np.full(len(i), d, dtype=np.int32))
                regions.append(names[order[i, j]])
            if rows:
                part = b.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(dims), pa.int32()), pa.array(np.concatenate(regions), pa.int32())], ["vec_id", "v", "floor", "dim", "region"])

    return asked.mapInArrow(run, "vec_id long, v array<long>, floor long, dim int, region int")


def top_inner_products(table: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, visits: list | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows with the highest integer inner products, ties to smaller ids; all, if there are fewer.

    table and queries: (vec_id long, v array<long>) as whole_vectors gives them; vectors only meet those of their own dimension. A row never answers a query with its own id. Repeated rows
    of table answer as often as they stand there; of repeated queries one counts. Without queries or rows the result is empty. visits: a list that takes, for each round, the visits of a query to a shard.
    """
    asked = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    dims = table.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").collect()
    n, dim = (dims[0]["n"], dims[0]["dim"]) if dims else (0, 0)
    depth = min(max(0, (-(-n // shard) - 1).bit_length()), REGIONS.bit_length() - 1)
    share = max(1, -(-SAMPLE * (1 << 20) // max(n, 1)))  # of the hashes below 2**20 that can be among the smallest
    some = table.filter((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < 2 * share)).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE) if depth else table.limit(0)
    sample = [r["v"] for r in some.select("v").collect()]
    splits = Splits(np.array(sample, dtype=np.int64).reshape(len(sample), dim), depth)
    rows = _placed(table, splits, dim)
    sizes = cut(rows.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts")))
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")  # repeated ids spread as well

    def build(key, data):
        tree = KDTree(data.column("vec_id").to_numpy().astype(np.int64), _matrix(data.column("v")))
        values = [*(pa.array([x.as_py()], pa.int32()) for x in key), pa.array([tree.to_bytes()], pa.binary()), pa.array([tree.low[0].tolist()], pa.list_(pa.int64())), pa.array([tree.high[0].tolist()], pa.list_(pa.int64()))]
        return pa.table(values, ["dim", "region", "part", "tree", "low", "high"])

    dealt = rows.join(sizes, ["dim", "region"]).select("dim", "region", salt.alias("part"), "vec_id", "v")
    trees = cut(dealt.groupBy("dim", "region", "part").applyInArrow(build, "dim int, region int, part int, tree binary, low array<long>, high array<long>"))
    boxes = {}
    for r in trees.select("dim", "region", "low", "high").collect():
        low, high = boxes.setdefault(r["dim"], {}).setdefault(r["region"], (np.array(r["low"]), np.array(r["high"])))
        np.minimum(low, r["low"], out=low)
        np.maximum(high, r["high"], out=high)
    boxes = {d: (np.array(list(x), dtype=np.int32), np.array([b[0] for b in x.values()]), np.array([b[1] for b in x.values()])) for d, x in ((d, dict(sorted(x.items()))) for d, x in boxes.items())}
    regions = max((len(x[0]) for x in boxes.values()), default=0)
    groups = max(1, -(-asked.count() // (BLOCK * BLOCKS)))

    def search(key, tree, block):
        out = {"query_id": [], "vec_id": [], "score": []}
        if tree.num_rows and block.num_rows:
            t = KDTree.from_bytes(tree.column("tree")[0].as_py())
            ids = block.column("vec_id").to_numpy().astype(np.int64)
            floors = block.column("floor").to_numpy(zero_copy_only=False).astype(np.int64)
            q = _matrix(block.column("v"))
            for at in range(0, len(ids), BLOCK):
                s = slice(at, at + BLOCK)
                for query, found in zip(ids[s].tolist(), t.search(q[s], ids[s], k, floors[s])):
                    for score, vec in found:
                        out["query_id"].append(query)
                        out["vec_id"].append(vec)
                        out["score"].append(score)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    keys = ["dim", "region", "part", "group"]
    parts = trees.select("dim", "region", "part")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    lowest = F.lit(-(1 << 63)).cast("long")
    best, floors, first, width = None, cut(asked.withColumn("floor", lowest)), 0, 1
    while first < regions:
        group = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups)).cast("int").alias("group")
        routed = cut(_routed(floors, boxes, first, first + width).join(parts, ["dim", "region"]).select("dim", "region", "part", group, "vec_id", "v", "floor"))
        if visits is not None:
            visits.append(routed.count())
        needed = routed.select(*(F.col(c).alias(c) for c in keys)).distinct()
        met = trees.select("tree", *(F.col(c).alias(c) for c in keys[:3])).join(needed, keys[:3])
        found = met.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
        ranked = (found if best is None else found.union(best)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        new = cut(ranked.select("query_id", "vec_id", "score"))
        drop_cut(routed)
        if best is not None:
            drop_cut(best)
        best = new
        first, width = first + width, width * GROWTH
        if first < regions:
            kth = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
            known = cut(asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("kth", lowest).alias("floor")))
            drop_cut(floors)
            floors = known
    for x in (rows, sizes, trees, floors):
        drop_cut(x)
    if best is None:
        return asked.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
