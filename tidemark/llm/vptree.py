"""Nearest neighbours by inner product with vantage-point trees per shard.

One more component, sqrt(M^2 - |x|^2) with M the largest length of all vectors, puts all candidates
on a sphere and turns the largest inner product into the smallest Euclidean distance. A node
holds a vantage point and the distance ranges of its nearer and farther half. By the triangle
inequality a half is no closer to a query than the gap between the query's distance and the
half's range; it is left out when ``factor`` times that gap exceeds the distance of the current
k-th neighbour. Factor 1 is exact, larger ones leave out more. Reported scores are inner
products of the original vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.balltree import EVERY, K, one_per_id
from tidemark.llm.search import Best, top_k

LEAF = 128
FACTOR = 1.2


class Vantage:
    __slots__ = ("point", "near", "far", "near_range", "far_range", "low", "high")

    def __init__(self, points: np.ndarray, order: np.ndarray, low: int, high: int):
        self.low, self.high, self.point = low, high, None
        if high - low <= LEAF:
            return
        own = points[order[low:high]]
        # The point farthest from the first one sees the rest from outside, which spreads distances.
        away = ((own - own[0]) ** 2).sum(axis=1)
        point = own[away.argmax()]
        distance = np.sqrt(((own - point) ** 2).sum(axis=1))
        if distance.max() == 0:
            return
        rank = np.argsort(distance, kind="stable")
        order[low:high] = order[low:high][rank]
        distance, middle = distance[rank], (high - low) // 2
        self.point = point
        self.near_range, self.far_range = (distance[0], distance[middle - 1]), (distance[middle], distance[-1])
        self.near, self.far = Vantage(points, order, low, low + middle), Vantage(points, order, low + middle, high)


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products in a fixed order of summation, so that equal vectors score equally."""
    return np.einsum("qd,nd->qn", queries, points, optimize=False)


def search_shard(k: int, factor: float, longest: float):
    def search(ids, points, query_ids, queries, kth):
        lift = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0.0))
        lifted = np.concatenate((points, lift[:, None]), axis=1)
        order = np.arange(len(ids))
        root = Vantage(lifted, order, 0, len(ids))
        ids, points = ids[order], np.ascontiguousarray(points[order])
        square = (queries**2).sum(axis=1)
        best = Best(len(query_ids), k, kth)

        def reach(q: np.ndarray) -> np.ndarray:
            """Distance of the current k-th neighbour, with room for rounding."""
            far = square[q] + longest**2 - 2 * best.kth(q)
            return np.sqrt(np.maximum(far, 0.0)) * (1 + 1e-9) + 1e-7 * (1 + longest)

        def visit(node: Vantage, q: np.ndarray) -> None:
            if node.point is None:
                for i in range(node.low, node.high, 1024):
                    here = ids[i : min(i + 1024, node.high)]
                    scores = products(queries[q], points[i : i + len(here)])
                    scores[query_ids[q][:, None] == here] = -np.inf
                    best.offer(q, scores, here)
                return
            d = np.sqrt(np.maximum(square[q] + longest**2 - 2 * (queries[q] @ node.point[:-1]), 0.0))
            near = np.maximum(np.maximum(node.near_range[0] - d, d - node.near_range[1]), 0.0) * factor
            far = np.maximum(np.maximum(node.far_range[0] - d, d - node.far_range[1]), 0.0) * factor
            first = d < (node.near_range[1] + node.far_range[0]) / 2
            for chosen, one, other, one_gap, other_gap in (
                (first, node.near, node.far, near, far),
                (~first, node.far, node.near, far, near),
            ):
                if chosen.any():
                    part = q[chosen]
                    go = part[one_gap[chosen] <= reach(part)]
                    if len(go):
                        visit(one, go)
                    go = part[other_gap[chosen] <= reach(part)]
                    if len(go):
                        visit(other, go)

        visit(root, np.arange(len(query_ids)))
        return best.rows(query_ids)

    return search


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, **options: int) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors found for each query.

    Vectors that are null, zero or hold null or non-finite components, and null ids, take no part; of
    a repeated id the smallest vector does. Shorter vectors count as filled up with zeros. Queries
    without another candidate and empty tables give no rows. Ties go to the smaller vec_id.
    """
    rows = one_per_id(embeddings).where(F.exists("embedding", lambda x: x != 0))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    longest = rows.agg(F.max(F.sqrt(square)).alias("m")).first()["m"] or 0.0
    return top_k(rows.select("vec_id", F.col("embedding").alias("v")), k, every, search_shard(k, factor, longest * (1 + 1e-12)), "double", **options)
