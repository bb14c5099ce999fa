"""Approximate nearest neighbours by collision-counting hashing with virtual rehashing.

A block of vectors is projected on random lines, and each line's values are cut into cells of equally
many. A query's window on every line is centred on its own projection and is a run of cells, so a
round of another width merges other cells and hashes nothing again. A vector that lies in more of the
windows than a threshold is verified by its exact distance. The last round is as wide as a vector as
far as the k-th best needs to be verified with the wanted probability. So windows follow the data and
no cap drops a candidate.

Windows are wide and the threshold high: a vector at distance 1 is in a window of half width w
with probability p = 2 F(w) - 1, F the normal distribution. The counts of two distances of a given
ratio are furthest apart, in their deviations, where w is about 1.5 (p = 0.87).

Such windows hold most of every line, so a round compares the cells of all vectors, a byte each,
instead of following the lists of each line's window. Cells at the ends of a window count whole: a
count is never below that of the window itself. Rounds go from wide to narrow: the k-th distance
among a few vectors bounds the width needed, the highest counts at that width give a nearer bound.
What is counted is still every query with every vector, so it grows as the square of the table if the
queries are a fixed share of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines; chance that a true neighbour is verified; how much wider than needed a last round may be;
#: rows of a block. A vector is sent once for each block of queries, so those are large.
LINES, CHANCE, GROWTH, BLOCK, QUERY_BLOCK = 256, 0.95, 1.08, 8192, 16384
#: Half a window, in distances, at which a vector is to be verified.
WIDE = 1.5
#: Cells of a line (their numbers are bytes); lines compared at once; for each of the k, vectors that give a
#: first bound and highest counts that give the next.
CELLS, AT_ONCE, START, FIRST = 256, 32, 2, 8


def _normal_quantile(p: float) -> float:
    low, high = -9.0, 9.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


class CollisionIndex:
    """Cells of one block's projections."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, lines: int = LINES, chance: float = CHANCE, seed: int = 5):
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids, self.m = vectors[order], ids[order], lines
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], lines))
        projected = np.ascontiguousarray((self.vectors @ self.directions).T)
        self.largest = float(np.abs(projected).max(initial=0.0))
        n = len(ids)
        self.bounds = np.sort(projected, axis=1)[:, np.arange(1, CELLS) * n // CELLS] if n else np.zeros((lines, CELLS - 1))
        # a value's cell never falls as the value grows, and equal values share one
        self.cells = np.empty((lines, n), np.uint8)
        for cells, bounds, values in zip(self.cells, self.bounds, projected):
            cells[:] = np.searchsorted(bounds, values, "right")
        self.deviations = _normal_quantile(chance)
        self.verified = self.rounds = 0

    def needed(self, wide: float) -> int:
        """The count that a vector reaches with the wanted probability in windows of half width wide times its distance."""
        share = math.erf(wide / math.sqrt(2))
        return max(0, math.floor(self.m * share - self.deviations * math.sqrt(self.m * share * (1 - share))))

    def windows(self, projected: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell of each query's window (column) on each line (row)."""
        low, high = np.empty(projected.shape, np.uint8), np.empty(projected.shape, np.uint8)
        for i, (bounds, line) in enumerate(zip(self.bounds, projected)):
            # copies of a query may differ from it in a projection's last digits
            reach = half + 1e-12 * (self.largest + np.abs(line))
            low[i], high[i] = np.searchsorted(bounds, line - reach, "right"), np.searchsorted(bounds, line + reach, "right")
        return low, high

    def counts(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many of one query's windows each vector is."""
        low, width = low[:, None], (high - low)[:, None]
        missed = np.zeros(len(self.ids), np.int32)
        for i in range(0, self.m, AT_ONCE):
            # cells below a window wrap around to numbers above its width
            out = self.cells[i : i + AT_ONCE] - low[i : i + AT_ONCE] > width[i : i + AT_ONCE]
            missed += np.add.reduce(out.view(np.uint8), axis=0, dtype=np.uint8)
        return self.m - missed

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, growth: float = GROWTH) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, distances) of the nearest k found for each query; own: the queries' ids."""
        some = FIRST * k
        projected = np.ascontiguousarray((queries @ self.directions).T)
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in own]
        seen = [np.zeros(0, np.int64) for _ in own]
        half = np.zeros(len(own))

        def verify(i: int, fresh: np.ndarray) -> None:
            self.verified += len(fresh)
            gap = self.vectors[fresh] - queries[i]
            ids = np.concatenate([best[i][0], self.ids[fresh]])
            d = np.concatenate([best[i][1], np.sqrt((gap * gap).sum(1))])
            pick = np.lexsort((ids, d))[:k]
            best[i], seen[i] = (ids[pick], d[pick]), np.concatenate([seen[i], fresh])

        open_ = []
        for i, me in enumerate(own):
            others = np.flatnonzero(self.ids != me)
            few = len(others) <= some
            verify(i, others if few else others[np.arange(START * k) * len(others) // (START * k)])
            if not few:
                half[i] = WIDE * best[i][1][-1]
                open_.append(i)
        while open_:
            wider = []
            low, high = self.windows(projected[:, open_], half[open_])
            for i, first, last in zip(open_, low.T, high.T):
                self.rounds += 1
                count = self.counts(first, last)
                count[self.ids == own[i]] = -1
                count[seen[i]] = -1
                fresh = np.flatnonzero(count >= self.needed(WIDE))
                if len(fresh) > some:
                    by_count = np.argpartition(count[fresh], -some)
                    verify(i, fresh[by_count[-some:]])
                    fresh = fresh[by_count[:-some]]
                    kth = best[i][1][-1]
                    if half[i] > growth * WIDE * kth:
                        half[i] = WIDE * kth
                        wider.append(i)
                        continue
                    if 0 < kth < math.inf:
                        # in a wider window the same chance asks for more
                        fresh = fresh[count[fresh] >= self.needed(half[i] / kth)]
                verify(i, fresh)
            open_ = wider
        return best


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part: id and vector not null, no null
    or non-finite component, not all zero, of the most frequent length (ties to the longer)."""
    v = F.col("vector")
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    read = read.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    length = read.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return read.filter(F.size("vector") == (length["length"] if length else 0))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, lines: int = LINES, chance: float = CHANCE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row whose id is divisible by
    every, by Euclidean distance in double precision, ties to smaller ids.

    Rows that usable() leaves out take no part, on either side. A query meets every row but those
    of its own id. Equal vectors are told apart by id. If there are fewer candidates, all are
    returned. An empty table gives no rows. Other columns are not read, whatever their names.
    Vectors are dealt into blocks by a hash of their ids and each block of queries meets each block
    of vectors, so a task holds one of either; a block of vectors keeps the k nearest of its own.
    """
    rows = usable(vectors, id_col, vector_col)
    queries = rows.filter(F.col("vec_id") % every == 0)
    n, n_queries = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    dealt = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    asked = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")
    every_block = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select(dealt.alias("vb"), every_block(query_blocks).alias("qb"), "vec_id", "vector")
    right = queries.select(every_block(blocks).alias("vb"), asked.alias("qb"), "vec_id", "vector")

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t["vec_id"].to_numpy()
        flat = t["vector"].combine_chunks()
        return (np.asarray(flat.flatten(), float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))), ids

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        x, ids = matrix(a)
        y, own = matrix(b)
        found = CollisionIndex(x, ids, lines, chance).search(y, own, k) if len(x) and len(y) else []
        return pa.table({
            "query_id": pa.array(np.repeat(own, [len(i) for i, _ in found]) if found else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([i for i, _ in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([d for _, d in found]) if found else [], pa.float64()),
        })

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
