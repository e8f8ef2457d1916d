"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed, fresh

#: Vectors of a shard, at most, and bytes; vectors of a leaf; cells that near vectors are dealt to, and vectors that those
#: are chosen from; bytes of shards' balls up to which they are broadcast.
SHARD, SHARD_BYTES, LEAF, CELLS, SAMPLE, BROADCAST_BYTES = 8192, 32 << 20, 64, 64, 4096, 32 << 20


def quantised(embedding: Column) -> Column:
    """floor(1024 * x) of each component as a double; null for a vector that is null or holds a null or non-finite one."""
    x = F.transform(embedding, lambda v: F.floor(v.cast("double") * 1024.0))
    sound = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), x)


class BallTree:
    """Balls over the rows of a matrix in arrays: node k has children 2k + 1 and 2k + 2, or is a leaf."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.ids = x, ids
        self.centre, self.radius, self.least, self.rows, self.child = [], [], [], [], []
        self._build(np.arange(len(x)))
        self.centre, self.radius, self.least = np.array(self.centre), np.array(self.radius), np.array(self.least)

    def _build(self, rows: np.ndarray) -> None:
        """A node is split across the two points found by going twice to the farthest one; one whose points are
        all alike stays a leaf, whatever its size."""
        work = [(rows, -1)]
        while work:
            rows, parent = work.pop()
            k, x = len(self.centre), self.x[rows]
            centre = x.mean(axis=0)
            far = np.sqrt(((x - centre) ** 2).sum(axis=1))
            self.centre.append(centre)
            self.radius.append(far.max())
            self.least.append(self.ids[rows].min())
            self.child.append([])
            self.rows.append(rows)
            if parent >= 0:
                self.child[parent].append(k)
            if len(rows) <= LEAF or far.max() < 1e-9:
                continue
            self.rows[k] = None
            a = x[far.argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            order = np.argsort(x @ (b - a), kind="stable")
            half = len(rows) // 2
            work += [(rows[order[:half]], k), (rows[order[half:]], k)]

    def search(self, queries: np.ndarray, own: np.ndarray, floor: list[int | None], k: int) -> list[list[tuple[int, int]]]:
        """For each query its best k rows by score, then smaller id, as (score, -id), without its own id.

        A node's inner products are at most the query's with its centre, plus the query's length times the
        radius. Nodes are opened by that bound; those below the kth score are not, nor those at it whose
        least id is above the kth's. floor is a score that k rows elsewhere are known to reach.
        """
        slack = 1e-6 * (1 + np.abs(queries).max(initial=0)) * (1 + np.abs(self.x).max(initial=0)) * queries.shape[1]
        bounds = queries @ self.centre.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radius[None, :] + slack
        out = []
        for q, query in enumerate(queries):
            best: list[tuple[float, int]] = []
            least = -np.inf if floor[q] is None else floor[q]
            heap = [(-bounds[q, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                kth = best[0][0] if len(best) == k else -np.inf
                if -bound < max(kth, least):
                    break
                if self.child[node]:
                    for c in self.child[node]:
                        heapq.heappush(heap, (-bounds[q, c], c))
                    continue
                if len(best) == k and -bound - 2 * slack <= kth and self.least[node] > -best[0][1]:
                    continue
                rows = self.rows[node]
                scores, ids = self.x[rows] @ query, self.ids[rows]
                keep = np.flatnonzero((scores >= max(kth, least)) & (ids != own[q]))
                if len(keep) > k:
                    keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
                for r in keep:
                    entry = (int(scores[r]), -int(ids[r]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            out.append(best)
        return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of integers in doubles, which multiply exactly below 2**53, else in 64-bit integers."""
    x = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    return x if x.size == 0 or np.abs(x).max() ** 2 * x.shape[1] < 2**52 else x.astype(np.int64)


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    tree = BallTree(_matrix(rows["v"]), rows["vec_id"].to_numpy())
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "centre": [tree.centre[0]], "radius": [tree.radius[0]], "tree": [pickle.dumps(tree)]})


BUILT = "dim int, shard bigint, centre array<double>, radius double, tree binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def _searched(k: int):
    """Of rows in the order of shards, a shard's tree before the queries for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for b in batches:
            found, rows = [], b.reset_index(drop=True)
            starts = [*np.flatnonzero(rows["tree"].notna()), len(rows)]
            for a, z in zip([0, *starts] if not starts or starts[0] else starts, starts if not starts or starts[0] else starts[1:]):
                part = rows.iloc[a:z]
                if len(part) and part["tree"].iloc[0] is not None:
                    tree, part = pickle.loads(part["tree"].iloc[0]), part.iloc[1:]
                if not len(part):
                    continue
                q = _matrix(part["q"])
                if q.dtype != tree.x.dtype:
                    q, tree.x = q.astype(np.int64), tree.x.astype(np.int64)
                floors = [None if pd.isna(f) else int(f) for f in part["floor"]]
                best = tree.search(q, part["query_id"].to_numpy(np.int64), floors, k)
                found += [(i, -n, s) for i, b_ in zip(part["query_id"], best, strict=True) for s, n in b_]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def _seek(trees: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """The best k of each query (dim, shard, query_id, q, floor) in its shard. A shard's tree goes to where its queries stream
    by, so that a task holds one tree and a batch, however many queries there are."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = trees.select("dim", "shard", "tree", none("bigint").alias("query_id"), none("array<bigint>").alias("q"), none("bigint").alias("floor"))
    rows = rows.unionByName(queries.select("dim", "shard", none("binary").alias("tree"), "query_id", "q", "floor"))
    order = ["dim", "shard", F.col("tree").isNull(), "query_id"]
    return rows.repartition(shards, "dim", "shard").sortWithinPartitions(*order).select("tree", "query_id", "q", "floor").mapInPandas(_searched(k), FOUND)


def _cells(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors up to CELLS of them far from one another, of a sample of SAMPLE by a hash. They say where
    vectors are dealt and so how many shards a query can pass by; results don't depend on them."""
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "v").limit(SAMPLE).select("dim", "v").collect()
    found = {}
    for dim in {r.dim for r in sample}:
        own = [r.v for r in sample if r.dim == dim]
        x = np.array(own, np.float64).reshape(len(own), dim)
        chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < min(CELLS, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        found[dim] = x[chosen]
    return found


def _dealt(cells: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.zeros(len(b), np.int64)
            for dim in b["dim"].unique():
                at = np.flatnonzero(b["dim"] == dim)
                if dim in cells:
                    x, c = np.array(b["v"].iloc[at].tolist(), np.float64).reshape(len(at), dim), cells[dim]
                    cell[at] = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
            yield b.assign(cell=cell)

    return run


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products for each row whose vec_id `every` divides.

    Near vectors are dealt to the same cell, and each cell's, by a hash, to shards of bounded size. A shard's tree is built
    once and checkpointed; only queries travel. A query first searches the shard whose ball has the highest bound for it;
    the kth score there is its floor in the others, of which it goes just to those whose ball's bound reaches the
    floor. So the kth score is shared once between shards, and by the search within each.

    Ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component take no part;
    vectors meet only those of their length; scores beyond 64 bits aren't defined. Rows that share an id are all
    candidates, a result for each; as a query the id's least vector counts. Empty tables give no rows; other columns,
    whatever their names, play no part.
    """
    sound = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL").withColumn("dim", F.size("v"))
    if not sound.groupBy("vec_id").count().where("count > 1").isEmpty():
        # Of rows with all alike no result holds more than k.
        copies = sound.groupBy("vec_id", "v", "dim").count()
        sound = checkpointed(copies.select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k).cast("bigint")))).alias("copy")))
    else:
        sound = sound.withColumn("copy", F.lit(1).cast("bigint"))
    longest = sound.agg(F.max("dim")).first()[0] or 0
    size = max(64, min(SHARD, SHARD_BYTES // (8 * max(1, longest))))
    placed = checkpointed(sound.mapInPandas(_dealt(_cells(sound)), "vec_id bigint, v array<bigint>, dim int, copy bigint, cell bigint"))
    # A shard's number: the cell's, and above that a part of it.
    parts = placed.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / size).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "v", "copy"), F.col("parts"))
    vectors = placed.join(F.broadcast(parts), ["dim", "cell"]).withColumn("shard", F.col("cell") + CELLS * part)
    trees = checkpointed(vectors.groupBy("dim", "shard").applyInPandas(_built, BUILT))
    balls = trees.select("dim", "shard", "centre", "radius")
    shards = max(1, balls.count())
    if shards * 8 * max(1, longest) <= BROADCAST_BYTES:
        balls = F.broadcast(balls)
    queries = placed.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "dim").agg(F.min("v").alias("q"))
    # An id's rows of other lengths are no queries of theirs, as its least vector is the query.
    queries = queries.groupBy("query_id").agg(F.min(F.struct("q", "dim")).alias("s")).select("query_id", "s.*")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q, c = F.transform("q", lambda x: x.cast("double")), F.col("centre")
    length = F.sqrt(dot(q, q))
    bound = dot(q, c) + length * F.col("radius")
    slack = (length * (F.sqrt(dot(c, c)) + F.col("radius")) + 1) * 1e-6
    pairs = queries.join(balls, "dim").select("query_id", "dim", "q", "shard", (bound + slack).alias("bound"))
    pairs = checkpointed(pairs) if shards > 1 else pairs
    home = checkpointed(pairs.groupBy("query_id").agg(F.max(F.struct("bound", "shard", "dim", "q")).alias("s")).select("query_id", "s.shard", "s.dim", "s.q"))
    found = first = checkpointed(_seek(trees, home.withColumn("floor", F.lit(None).cast("bigint")), shards, k))
    if shards > 1:
        floors = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("floor")).select("query_id", F.when(F.col("c") >= k, F.col("floor")).alias("floor"))
        others = pairs.join(fresh(home.select("query_id", "shard")), ["query_id", "shard"], "left_anti").join(fresh(floors), "query_id", "left")
        others = others.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        found = first.union(_seek(trees, others, shards, k))
    # A query has k rows from each shard at most.
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
