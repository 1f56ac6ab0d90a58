"""Exact top-k inner products with a KD-tree in each shard.

Vectors are dealt to shards of bounded size. A shard builds a KD-tree by median splits along the widest side, with tight
bounding boxes. For a query, nodes are opened best first by the largest inner product that their box allows; a node
whose bound doesn't beat the kth score so far is dropped (at equal score the smaller vec_id wins, so a node also keeps
its smallest vec_id). A first round looks at each shard's most promising leaf only; the kth best score over all shards
then starts the full traversal in every shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.storage import materialize, small_batches

SCALE, K, LEAF = 1024, 10, 128
#: Vectors of a shard, and queries that one group holds; a shard meets the queries block by block.
SHARD_ROWS, QUERY_ROWS = 16_384, 2_048


class Tree:
    """KD-tree over integer vectors; rows are reordered so that each leaf is a slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf = ids[order], vectors[order], leaf
        self.nodes: list[tuple[int, int, int, int]] = []  # slice, children
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.min_id: list[int] = []
        if len(ids):
            self._build(0, len(ids))
            self.low_m, self.high_m = np.stack(self.low), np.stack(self.high)

    def _build(self, a: int, b: int) -> int:
        me = len(self.nodes)
        part = self.vectors[a:b]
        low, high = part.min(0), part.max(0)
        self.nodes.append((a, b, -1, -1))
        self.low.append(low)
        self.high.append(high)
        self.min_id.append(int(self.ids[a:b].min()))
        wide = int(np.argmax(high - low))
        if b - a > self.leaf and high[wide] > low[wide]:
            mid = (b - a) // 2
            order = np.argpartition(part[:, wide], mid)
            self.vectors[a:b], self.ids[a:b] = part[order], self.ids[a:b][order]
            left = self._build(a, a + mid)
            self.nodes[me] = (a, b, left, self._build(a + mid, b))
        return me

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each node the largest inner product that its box allows."""
        return self.high_m @ np.maximum(query, 0) + self.low_m @ np.minimum(query, 0)

    def search(self, query: np.ndarray, own: int, k: int, floor: tuple | None = None, one_leaf: bool = False) -> list[tuple]:
        """The k best (score, -vec_id) pairs, best first, that aren't below ``floor``; own: the query's id, left out."""
        if not self.nodes:
            return []
        bound = self.bounds(query)
        best: list[tuple] = []  # a heap with the worst kept pair on top
        queue = [(-bound[0], self.min_id[0], 0)]
        while queue:
            up, low_id, node = heapq.heappop(queue)
            least = best[0] if len(best) == k else None
            if floor is not None and (least is None or floor > least):
                least = floor
            if least is not None and (-up, -low_id) < least:
                if -up < least[0]:
                    break
                continue
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(queue, (-bound[child], self.min_id[child], child))
                continue
            scores = self.vectors[a:b] @ query
            for i in np.flatnonzero(scores >= least[0]).tolist() if least is not None else range(b - a):
                pair = (scores[i], -int(self.ids[a + i]))
                if -pair[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, pair)
                elif pair > best[0]:
                    heapq.heapreplace(best, pair)
            if one_leaf:
                break
        return sorted(best, reverse=True)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Integer components; as doubles where every sum of products is exact, else as Python integers."""
    m = np.array(vectors.tolist(), np.int64).reshape(len(vectors), -1)
    top = int(np.abs(m).max(initial=0))
    return m.astype(np.float64) if top * top * max(1, m.shape[1]) < 1 << 53 else m.astype(object)


def _search_group(k: int, one_leaf: bool):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            tree = Tree(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"]))
            floors = zip(queries["floor_score"], queries["floor_id"], strict=True)
            points = _matrix(queries["v"])
            if points.dtype != tree.vectors.dtype:
                points, tree.vectors = points.astype(object), tree.vectors.astype(object)
                tree.low_m, tree.high_m = tree.low_m.astype(object), tree.high_m.astype(object)
            for own, q, (score, vec) in zip(queries["vec_id"].tolist(), points, floors, strict=True):
                floor = None if pd.isna(score) else (int(score), -int(vec))
                out += [(int(own), -i, int(s)) for s, i in tree.search(q, int(own), k, floor, one_leaf)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): components floor(1024 * x); vectors that are null, empty or hold a null or non-finite component
    and rows without vec_id take no part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long"), x.alias("embedding")).filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return kept.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def top_k(vectors: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by ``every`` its k highest integer inner
    products with all other rows of the same length; ties go to the smaller vec_id, fewer rows give fewer ranks.

    ``vectors`` has vec_id and embedding; other columns are ignored. A repeated vec_id is a query each time it differs
    in its vector (equal rows are one query) and all its rows are candidates to others. An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    rows = materialize(quantized(vectors), "vectors")
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    # a salt of the row's place deals repeated vec_ids out as well
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.rand(7)), F.lit(shards))) if shards > 1 else rows.withColumn("shard", F.lit(0).cast("long"))
    dealt = materialize(dealt, "vectors-dealt")
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)))
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("block")
    keys = ["dim", "shard", "block"]
    left = dealt.select("vec_id", "dim", "v", "shard", every_block).groupBy(*keys)
    no_floor = blocked.withColumn("floor_score", F.lit(None).cast("long")).withColumn("floor_id", F.lit(None).cast("long"))

    def searched(q: DataFrame, one_leaf: bool) -> DataFrame:
        cols = ["vec_id", "dim", "v", "block", "floor_score", "floor_id", every_shard]
        return left.cogroup(q.select(*cols).groupBy(*keys)).applyInPandas(_search_group(k, one_leaf), "query_id long, vec_id long, score long")

    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)

    if shards == 1:
        found = searched(no_floor, one_leaf=False)
    else:
        # the kth of what one leaf of each shard gives is a floor for every shard; a vec_id with several vectors has none
        single = queries.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("vec_id").alias("query_id"))
        floors = ranked(searched(no_floor, one_leaf=True)).filter(F.col("rank") == k).join(single, "query_id")
        floors = floors.select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
        found = searched(blocked.join(floors, "vec_id", "left"), one_leaf=False)
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
