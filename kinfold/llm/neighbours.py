"""Nearest neighbours by inner product, with collision-counting hashing.

Inner products become distances: vectors are divided by the largest norm and get one
more component that brings each to norm 1 (a query gets 0 there), which leaves the
order of a query's candidates by distance what it is by inner product. A shard of
vectors keeps, for each of PROJECTIONS random directions, its vectors' projections as
one sorted array, cut into STRETCHES of equal size; a vector is known by the number of
its stretch, a byte. A query's window in every array starts at its own projection and
is widened step by step (virtual rehashing: the width belongs to a radius, and no
array is built anew); a vector collides with the query in each array whose window, up
to the ends of stretches, holds it. Collisions are counted for a few queries at once,
and a vector that already lacks too many after the first arrays is counted no further.
Vectors with enough collisions are verified on the original components in double
precision. A radius is enough once k verified vectors lie within it; if k are verified,
but not all of them within it, the distance of the k-th is the next radius and the last,
unless a smaller step comes first: no nearer vector can be farther. A vector within a radius collides in each window with
probability P_NEAR at least, and THRESHOLD is so far below the expected count that a true
neighbour is missed in a few of a hundred cases at most.

Queries in blocks meet all shards, each pair of block and shard in a task of its own.
Shards and blocks are of bounded size, however many vectors or queries there are.

Defined results: vectors that are null, zero, hold null, NaN or infinite components,
or have not the most common number of components (ties: the larger) take no part, and
neither do rows with a null id. A repeated id is one candidate for each row; as a
query it asks once, with the least of its vectors, and none of its rows is a candidate
for it. Ties go
to the smaller id. Fewer than k candidates: all of them. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many projections tell a vector just within the radius from one a tenth farther: about 4 % of 10,000 vectors are verified for
#: a query, where 128 projections would leave 20 to 30 %.
PROJECTIONS, SEED = 512, 4
#: Half width of a window for radius 1; the first radius is FIRST. Each wider one is COARSE times the one before while
#: nothing has been verified, then at most FINE. Windows this wide leave little out, so it is the arrays outside whose windows a vector is that are counted.
HALF, FIRST, COARSE, FINE = 1.5, 0.2, 1.08, 1.02
#: The first PILOT queries of a block start at FIRST; the others at EARLY times the median of the radii that these needed.
PILOT, EARLY = 8, 1.0
P_NEAR = math.erf(HALF / math.sqrt(2))


def _allowed(projections: int, deviations: float) -> int:
    """How many of so many windows may miss a vector just within the radius, which is that far over what is expected."""
    return math.ceil(projections * (1 - P_NEAR) + deviations * math.sqrt(projections * P_NEAR * (1 - P_NEAR)))


#: 1.6 standard deviations below what a vector just within the radius is expected to reach; nearer ones reach more. Measured recall: 0.99.
THRESHOLD = PROJECTIONS - _allowed(PROJECTIONS, 1.6)
#: Arrays that are counted for all vectors, and for those that are left after them; at these points 2.5 deviations are allowed.
#: The steps are multiples of 64, as many as a word has bits.
EVERY, SOME = 192, 320
MISSES_EVERY, MISSES_SOME = _allowed(EVERY, 2.5), _allowed(SOME, 2.5)
STRETCHES = 256
#: Queries that are counted at once.
TOGETHER = 16
#: Vectors in a shard and queries in a block, on average.
SHARD, BLOCK = 16_384, 8192
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


class _Query:
    """What has been verified for a query, and the radius it has come to."""

    def __init__(self, own: int, vector: np.ndarray):
        self.id, self.vector, self.norm, self.radius = own, vector, float(np.sqrt(vector @ vector)), FIRST
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0)


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        self.looked = 0  # vectors verified so far, for all queries
        n, d = vectors.shape
        rest = np.sqrt(np.maximum(0, 1 - (vectors**2).sum(1) / largest**2))
        self.directions = np.random.default_rng(SEED).standard_normal((d + 1, PROJECTIONS))
        placed, stretch = np.c_[vectors / largest, rest], (np.arange(n) * STRETCHES // n).astype(np.uint8)
        ends = np.unique(stretch, return_index=True)[1]  # where each stretch starts in a sorted array
        codes, edges = np.empty((PROJECTIONS, n), np.uint8), np.empty((PROJECTIONS, len(ends)))
        for i in range(0, PROJECTIONS, 64):
            places = np.ascontiguousarray((placed @ self.directions[:, i : i + 64]).T)
            order = np.argsort(places, axis=1, kind="stable")
            np.put_along_axis(codes[i : i + 64], order, stretch[None, :], 1)
            edges[i : i + 64] = np.take_along_axis(places, order[:, ends], 1)
        self.stretches, self.numbers = len(ends), stretch[ends]
        # one array for all directions: each has a part of its own of this width
        self.apart = 4 * float(np.abs(edges).max()) + 4 * float(np.abs(self.directions).sum(0).max()) + 1
        self.edges = (edges + np.arange(PROJECTIONS)[:, None] * self.apart).ravel()
        self.every = codes[:EVERY].copy()
        self.some, self.others = np.ascontiguousarray(codes[EVERY:SOME].T), np.ascontiguousarray(codes[SOME:].T)

    def _windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First stretch and how many follow it, of each query's window in each array; at: queries by arrays."""
        starts = np.arange(PROJECTIONS) * self.stretches
        low, high = (np.clip(np.searchsorted(self.edges, at + x, side) - starts, 1, self.stretches) - 1 for x, side in ((-half[:, None], "left"), (half[:, None], "right")))
        return self.numbers[low], self.numbers[high] - self.numbers[low]

    @staticmethod
    def _missed(codes: np.ndarray, low: np.ndarray, span: np.ndarray) -> np.ndarray:
        """In how many windows each row of codes is not."""
        words = np.packbits((codes - low) > span, axis=1).view(np.uint64)
        return sum((np.bitwise_count(words[:, i]).astype(np.int64) for i in range(words.shape[1])), np.zeros(len(codes), np.int64))

    def _colliding(self, low: np.ndarray, span: np.ndarray) -> list[np.ndarray]:
        """Rows with enough collisions, for each query."""
        misses = np.zeros((len(low), len(self.ids)), np.uint8)
        apart, out = np.empty_like(misses), np.empty(misses.shape, bool)
        for i in range(EVERY):
            np.subtract(self.every[i], low[:, i, None], out=apart)
            np.greater(apart, span[:, i, None], out=out)
            np.add(misses, out.view(np.uint8), out=misses)
        found = []
        for q in range(len(low)):
            rows = np.flatnonzero(misses[q] <= MISSES_EVERY)
            so_far = misses[q, rows] + self._missed(self.some[rows], low[q, EVERY:SOME], span[q, EVERY:SOME])
            left = so_far <= MISSES_SOME
            rows, so_far = rows[left], so_far[left]
            found.append(rows[so_far + self._missed(self.others[rows], low[q, SOME:], span[q, SOME:]) <= PROJECTIONS - THRESHOLD])
        return found

    def answer(self, ids: list[int], queries: list[np.ndarray], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(id, ids of its k nearest, inner products) of each query; its own id is no candidate."""
        vectors = np.stack(queries)
        asked = [_Query(i, v) for i, v in zip(ids, vectors, strict=True)]
        self._widen(asked[:PILOT], k)
        start = EARLY * float(np.median([q.radius for q in asked[:PILOT]]))
        for q in asked[PILOT:]:
            q.radius = start
        self._widen(asked[PILOT:], k)
        return [(q.id, *self._best(q, k)) for q in asked]

    def _widen(self, asked: list[_Query], k: int) -> None:
        """Verify until each query's radius is enough; those that need another one queue again, so that there are always some to count together."""
        queue = deque(asked)
        while queue:
            some = [queue.popleft() for _ in range(min(TOGETHER, len(queue)))]
            at = np.stack([np.append(q.vector / q.norm, 0.0) for q in some]) @ self.directions + np.arange(PROJECTIONS) * self.apart
            low, span = self._windows(at, HALF * np.array([q.radius for q in some]))
            whole = (span == self.numbers[-1]).all(axis=1)
            for q, found, all_of_them in zip(some, self._colliding(low, span), whole.tolist(), strict=True):
                new = np.setdiff1d(found[self.ids[found] != q.id], q.rows, assume_unique=True)
                self.looked += len(new)
                q.rows, q.scores = np.r_[q.rows, new], np.r_[q.scores, self.vectors[new] @ q.vector]
                if all_of_them:
                    continue
                if len(q.rows) < k:
                    q.radius *= FINE if len(q.rows) else COARSE
                    queue.append(q)
                    continue
                # distance of the normed vectors; the k-th best must lie within the radius
                kth = math.sqrt(max(0.0, 2 - 2 * np.partition(q.scores, len(q.scores) - k)[len(q.scores) - k] / (q.norm * self.largest)))
                if kth > q.radius:
                    q.radius = min(kth * (1 + 1e-9), q.radius * FINE)
                    queue.append(q)

    def _best(self, q: _Query, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = q.rows[np.lexsort((self.ids[q.rows], -q.scores))[: 2 * k]]
        every = (self.vectors[rows] * q.vector).sum(1)  # the same sum for equal vectors, wherever they stand
        best = np.lexsort((self.ids[rows], -every))[:k]
        return self.ids[rows[best]], every[best]


def _usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all other vectors for each row that the condition `queries` picks."""
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks")).filter(F.col("id").isNotNull() & _usable("v"))
    sizes = good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("s")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not sizes:
        return good.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    size, n, asked, largest = sizes[0]["size"], sizes[0]["n"], sizes[0]["q"] or 0, math.sqrt(sizes[0]["s"])
    shards, blocks = -(-n // SHARD), max(1, -(-asked // BLOCK))
    good = good.filter(F.size("v") == size)
    candidates = good.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asking = good.filter("asks").groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def meet(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        shard = Shard(own["id"].to_numpy(), np.stack(own["v"].to_numpy()), largest)
        block = block.sort_values("id")
        out = shard.answer(block["id"].tolist(), list(block["v"].to_numpy()), k)
        return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in out], [len(x) for _, x, _ in out]), "vec_id": np.concatenate([x for _, x, _ in out]), "score": np.concatenate([s for _, _, s in out])})

    met = candidates.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInPandas(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
