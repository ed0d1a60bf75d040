"""Centroid clustering with an equal-average equal-variance search, exact in integers.

Two facts about vectors of d components: d times their squared distance is at least the squared difference of their sums,
and at least that plus the squared difference of their deviations (the root of d times the sum of squares, less the squared
sum). Centroids are sorted by their sum. A vector starts at the centroid next to its own sum and goes outward, nearer
first; once the difference of sums alone rules one out, all others are ruled out too. A centroid that the deviations
rule out is passed over, and only for what is left the distance is computed, in integers. The first test is done in integers; the
second in floating point with a margin well over its rounding, so it never passes over a centroid that could win or tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.llm.common import write_out
from fleetloom.session import ship_package

LARGEST = 1 << 30  # number of components times the largest after scaling: the integers of both tests then fit in 64 bits
ROWS = 4096  # vectors searched at a time


def grid(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``dims`` components, all finite, and those as integers floor(scale * x)."""
    n = len(column)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    keep = (sizes == dims) & ~np.asarray(lists.is_null())
    x = lists.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:n][keep]
    v = x[starts[:, None] + np.arange(dims)] if len(starts) else np.zeros((0, dims))
    finite = np.isfinite(v).all(1)
    keep[np.flatnonzero(keep)[~finite]] = False
    v = np.floor(v[finite] * scale)
    if np.abs(v).max(initial=0) * dims > LARGEST:
        raise ValueError(f"a scaled component is beyond {LARGEST // dims}: distances would not fit in a long")
    return keep, v.astype(np.int64)


class Codebook:
    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        sums = centroids.sum(1)
        self.order = np.lexsort((np.arange(len(sums)), sums))
        self.sums = sums[self.order]
        self.dims = centroids.shape[1]
        self.deviation = self._deviation(centroids[self.order])

    def _deviation(self, v: np.ndarray) -> np.ndarray:
        total = v.sum(1)
        return np.sqrt((self.dims * (v * v).sum(1) - total * total).astype(np.float64))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (the smaller one of equals), squared distance, and how many distances were computed."""
        n, k, d = len(v), len(self.order), self.dims
        total, dev = v.sum(1), self._deviation(v)
        high = np.searchsorted(self.sums, total)
        low = high - 1
        best = np.full(n, np.iinfo(np.int64).max // d - 1)
        number = np.full(n, k)
        at, computed = np.arange(n), 0
        for _ in range(k):
            lo, hi, s = low[at], high[at], total[at]
            gap_low, gap_high = s - self.sums[np.maximum(lo, 0)], self.sums[np.minimum(hi, k - 1)] - s
            down = (lo >= 0) & ((hi >= k) | (gap_low <= gap_high))
            gap = np.where(down, gap_low, gap_high)
            left = gap * gap <= best[at] * d
            at, down, gap, lo, hi = at[left], down[left], gap[left], lo[left], hi[left]
            if not len(at):
                break
            place = np.where(down, lo, hi)
            low[at[down]] -= 1
            high[at[~down]] += 1
            own, other = dev[at], self.deviation[place]
            bound = gap.astype(np.float64) ** 2 + (own - other) ** 2
            may = bound - 1e-9 * (bound + own * own + other * other) - 1 <= best[at].astype(np.float64) * d
            who, whom = at[may], self.order[place[may]]
            apart = v[who] - self.centroids[whom]
            distance = np.einsum("ij,ij->i", apart, apart)
            computed += len(who)
            wins = (distance < best[who]) | ((distance == best[who]) & (whom < number[who]))
            best[who[wins]], number[who[wins]] = distance[wins], whom[wins]
        return number, best, computed


def _lists(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dims)


def integer_vectors(df: DataFrame, vector: str, vec_id: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, v): the vectors that count, as integers; written, as every round reads them."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, v = grid(batch.column("x"), dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(keep)), _lists(v)], ["vec_id", "v"])

    return write_out(rows.mapInArrow(run, T.StructType([rows.schema["vec_id"], T.StructField("v", T.ArrayType(T.LongType()))])), "vectors")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``seed:vec_id``; equal ids by their components, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, book: Codebook) -> np.ndarray:
    """Centroids after one round: floor of the mean of each centroid's vectors, empty ones as they were.

    Every task sums its own vectors; what reaches the driver is one row per centroid.
    """
    dims, k = book.dims, len(book.order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _vectors(batch, dims)
            for i in range(0, len(v), ROWS):
                part = v[i : i + ROWS]
                number, _, _ = book.nearest(part)
                inside = np.zeros((k, len(part)))
                inside[number, np.arange(len(part))] = 1
                # Whole numbers below 2^53 in floating point: exact.
                sums += (inside @ part.astype(np.float64)).astype(np.int64)
                n += np.bincount(number, minlength=k)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(n[have]), _lists(sums[have])], ["cluster", "n", "s"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, s array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(dims)]).alias("s"))
    centroids = book.centroids.copy()
    for r in total.collect():
        centroids[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return centroids


def cluster_vectors(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64, seed: int = 1,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that counts, and the final centroids.

    A vector counts when it has ``dims`` components, none null, NaN or infinite; others have no row. Components become
    floor(scale * x); ``dims`` times the largest may be 2^30, beyond that it is an error, since the tests would not fit in a long. The ``k`` centroids are all that the
    driver holds. With fewer vectors than ``k`` each is a centroid; an empty table gives no rows. Repeated rows and
    ids are clustered like any other row. Columns that are not named are not read.
    """
    vectors = integer_vectors(df, vector, vec_id, dims, scale)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(vectors, Codebook(centroids))
    book = Codebook(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch, dims)
            found = [book.nearest(v[i : i + ROWS]) for i in range(0, len(v), ROWS)]
            number = np.concatenate([np.zeros(0, np.int32), *[f[0].astype(np.int32) for f in found]])
            distance = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kinds = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.mapInArrow(run, kinds), centroids
