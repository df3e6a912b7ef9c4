"""Sharded top-k search: what the exact and the approximate index have in common.

Candidates are dealt by a hash of their id into shards of about ``shard_rows`` rows; queries into
blocks of about ``query_block``. A task gets one shard and one block, indexes the shard and searches
it. Shards are searched in rounds of 1, 7, 56, ... shards: the merged k-th scores of one round start
the search of the next, so a shard returns only what beats them and a query gathers rows in
proportion to the number of rounds, not of shards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buckets_for, stored

SHARD_ROWS = 16_384
QUERY_BLOCK = 4096
GROWTH = 8

# (candidate ids, vectors, query ids, query vectors, k-th scores so far or -inf) -> query rows, ids, scores
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), flat.dtype)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    out[rows, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def whole_numbers(first: int, last: int) -> Column:
    return F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))


def top_k(
    vectors: DataFrame, k: int, every: int, search: Search, score_type: str, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query id divisible by ``every``.

    ``vectors`` has vec_id and v (an array), one row per id. Ties go to the smaller id.
    """
    rows = stored(vectors, "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    shards, width = buckets_for(size["n"], shard_rows), size["width"] or 1
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("asked_id"), F.col("v").alias("asked_v"))
    blocks = buckets_for(asked.count(), query_block)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("asked_id", F.lit(1)), F.lit(blocks)))
    best: DataFrame | None = None
    schema = f"query_id long, vec_id long, score {score_type}"

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            q, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            left, right = left.sort_by("vec_id"), right.sort_by("asked_id")
            q, ids, scores = search(
                left["vec_id"].to_numpy(),
                matrix(left["v"], width),
                right["asked_id"].to_numpy(),
                matrix(right["asked_v"], width),
                right["kth"].to_numpy().astype(np.float64),
            )
        kind = pa.int64() if score_type == "long" else pa.float64()
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, kind)})

    first, last = 0, 1
    while first < shards:
        last = min(last, shards)
        part = dealt.where((F.col("shard") >= first) & (F.col("shard") < last))
        # Every shard meets every block of the stated query set; copies of rows are one per block.
        left = part.select("vec_id", "v", "shard", F.explode(whole_numbers(0, blocks - 1)).alias("block"))
        if best is None:
            right = asked.withColumn("kth", F.lit(float("-inf")))
        else:
            bound = best.where(F.col("rank") == k).select(F.col("query_id").alias("asked_id"), F.col("score").cast("double").alias("kth"))
            right = asked.join(bound, "asked_id", "left").fillna({"kth": float("-inf")})
        shard = F.explode(whole_numbers(first, last - 1)).alias("asked_shard")
        right = right.select("asked_id", "asked_v", "kth", F.col("block").alias("asked_block"), shard)
        found = left.groupBy("shard", "block").cogroup(right.groupBy("asked_shard", "asked_block")).applyInArrow(task, schema)
        if best is not None:
            found = found.unionByName(best.select("query_id", "vec_id", "score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        first, last = last, last * GROWTH
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Best:
    """The k best (score, id) of every query of a block, with a lower bound known from elsewhere."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor
        self.k = k

    def kth(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[q, -1], self.floor[q])

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of shape (len(q), len(ids)); -inf takes no part."""
        some = scores.max(axis=1) >= self.kth(q)
        q, scores = q[some], scores[some]
        for i in range(0, len(q), 1024):
            part = q[i : i + 1024]
            s = np.concatenate((self.scores[part], scores[i : i + 1024]), axis=1)
            d = np.concatenate((self.ids[part], np.broadcast_to(ids, (len(part), len(ids)))), axis=1)
            order = np.lexsort((d, -s), axis=1)[:, : self.k]
            self.scores[part] = np.take_along_axis(s, order, axis=1)
            self.ids[part] = np.take_along_axis(d, order, axis=1)

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        good = np.isfinite(self.scores) & (self.scores >= self.floor[:, None])
        return np.repeat(query_ids, good.sum(axis=1)), self.ids[good], self.scores[good]
