"""Exact top-k inner product search with a ball tree per shard.

Every node is a ball: centre, radius, and the smallest id in it. No point of a ball has an inner
product with q above q.centre + |q| radius. A block of queries walks the tree together; at every
node the queries that prefer the left child by that bound go left first, the others right first,
and a query leaves a subtree whose bound is below its current k-th score, which starts from the
k-th score shared by earlier shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.search import Best, top_k

LEAF = 128
K = 20
EVERY = 20
SCALE = 64
EXACT = 2.0**53


class Ball:
    __slots__ = ("centre", "radius", "low", "high", "left", "right")

    def __init__(self, points: np.ndarray, order: np.ndarray, low: int, high: int):
        own = points[order[low:high]]
        self.centre = own.mean(axis=0)
        away = np.sqrt(((own - self.centre) ** 2).sum(axis=1))
        self.radius, self.low, self.high = float(away.max()), low, high
        self.left = self.right = None
        if high - low <= LEAF or self.radius == 0:
            return
        # Split at the median along the line between two far points.
        a = own[away.argmax()]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        middle = (high - low) // 2
        order[low:high] = order[low:high][np.argsort(own @ (b - a), kind="stable")]
        self.left, self.right = Ball(points, order, low, low + middle), Ball(points, order, low + middle, high)


def search_shard(k: int):
    def search(ids, points, query_ids, queries, kth):
        points, queries = points.astype(np.float64), queries.astype(np.float64)
        order = np.arange(len(ids))
        root = Ball(points, order, 0, len(ids))
        points, ids = points[order], ids[order]
        lengths = np.sqrt((queries**2).sum(axis=1))
        best = Best(len(query_ids), k, kth)
        exact = np.abs(points).max(initial=0) * np.abs(queries).max(initial=0) * points.shape[1] < EXACT

        def bound(node: Ball, q: np.ndarray) -> np.ndarray:
            b = queries[q] @ node.centre + lengths[q] * node.radius
            return b + 1e-9 * (np.abs(b) + lengths[q] * (node.radius + np.linalg.norm(node.centre))) + 1e-6

        def visit(node: Ball, q: np.ndarray) -> None:
            if node.left is None:
                if exact:
                    for i in range(node.low, node.high, 1024):
                        here = ids[i : min(i + 1024, node.high)]
                        scores = queries[q] @ points[i : i + len(here)].T
                        scores[query_ids[q][:, None] == here] = -np.inf
                        best.offer(q, scores, here)
                else:
                    _offer_large(node, q)
                return
            left, right = bound(node.left, q), bound(node.right, q)
            first = left >= right
            for chosen, near, far, near_bound, far_bound in (
                (first, node.left, node.right, left, right),
                (~first, node.right, node.left, right, left),
            ):
                if chosen.any():
                    part = q[chosen]
                    go = part[near_bound[chosen] >= best.kth(part)]
                    if len(go):
                        visit(near, go)
                    go = part[far_bound[chosen] >= best.kth(part)]
                    if len(go):
                        visit(far, go)

        def _offer_large(node: Ball, q: np.ndarray) -> None:
            # Beyond 2**53 doubles are not exact: Python integers, held at the ends of a long.
            here = ids[node.low : node.high]
            whole = [[int(x) for x in p] for p in points[node.low : node.high]]
            for i in q:
                own = [int(x) for x in queries[i]]
                s = np.array([[float(min(max(sum(map(int.__mul__, own, p)), -(2**63)), 2**63 - 1025)) for p in whole]])
                s[0, query_ids[i] == here] = -np.inf
                best.offer(np.array([i]), s, here)

        q = np.arange(len(query_ids))
        visit(root, q[bound(root, q) >= best.kth(q)])
        found, who, scores = best.rows(query_ids)
        return found, who, scores.astype(np.int64)

    return search


def usable(embedding: Column, scaled: Column) -> Column:
    """True for vectors that are not null and hold neither nulls nor non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull() & scaled.isNotNull()


def one_per_id(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles; of a repeated id the smallest usable vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable(F.col("embedding"), F.col("embedding")))
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def exact_top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, **options: int) -> DataFrame:
    """query_id, rank, vec_id, score over vectors floor(scale * x).

    Vectors that are null or hold null or non-finite components, and null ids, take no part; of a
    repeated id the smallest vector does. Shorter vectors count as filled up with zeros. Queries
    without another candidate and empty tables give no rows. Ties go to the smaller vec_id. Products
    beyond 2**53 are summed as integers but compared as doubles.
    """
    steps = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    return top_k(one_per_id(embeddings).select("vec_id", steps.alias("v")), k, every, search_shard(k), "long", **options)
