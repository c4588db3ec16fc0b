"""Centroid clustering with exact integers, centroids filtered by n-simplex bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.vectors import usable
from frostline.llm.workspace import Batches, bounded_batches, map_rows, saved, text_rows

#: Components have to be smaller than this, so that every squared distance is a long.
LIMIT = 1 << 26
#: Share of a bound by which rounding may have moved it.
SLACK = 1e-6


def whole_vectors(table: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id and `x`, floor(scale * component) as 32-bit integers, of vectors of `width`."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, lengths, x = usable(b.column("embedding"))
        fit = lengths == width
        rows, starts = rows[fit], starts[fit]
        whole = np.floor(scale * x[starts[:, None] + np.arange(width)])
        if whole.size and np.abs(whole).max() >= LIMIT:
            raise ValueError(f"components of {LIMIT} and more are too large for exact distances")
        raw = [v.tobytes() for v in whole.astype("<i4")]
        return pa.record_batch([b.column("vec_id").take(pa.array(rows)), pa.array(raw, pa.binary())], ["vec_id", "x"])

    rows = text_rows(table, "vec_id", "embedding")
    return map_rows(rows, batch, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x binary")


def matrix(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), width).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of `a` to the few rows of `b`."""
    return np.stack([((a - y) ** 2).sum(axis=1) for y in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


class Simplex:
    """The simplex of a few pivots. An object's distances to the pivots make it the apex over
    this base: coordinates within the pivots' subspace, and its height above that.

    Between two apexes on the same side the distance is at most, and between apexes on
    opposite sides at least, that of the objects. Pivots which lie in the subspace of those
    before them are left out.
    """

    def __init__(self, candidates: np.ndarray, pivots: int):
        chosen, base = [], np.zeros((0, 0))
        for row in range(len(candidates)):
            if len(chosen) == pivots:
                break
            d = np.sqrt(squared(candidates[row : row + 1], candidates[chosen]).astype(float))
            apex = self._apex(base, d)[0] if chosen else np.zeros(0)
            if not chosen or apex[-1] > 1e-2 * max(1.0, d.max()):
                # the new vertex has as many coordinates as there are pivots before it
                grown = np.zeros((len(chosen) + 1, len(chosen)))
                grown[: len(chosen), : base.shape[1]] = base
                grown[len(chosen)] = apex
                chosen.append(row)
                base = grown
        self.pivots, self.base = candidates[chosen], base

    @staticmethod
    def _apex(base: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Apexes from distances (one row each) to the vertices of `base`."""
        n = base.shape[0]
        if not n:
            return np.zeros((len(d), 0))
        out = np.zeros((len(d), n))
        squares = d * d
        # |x - v_i|^2 - |x - v_0|^2 gives coordinate i - 1, since v_i has no later ones
        for i in range(1, n):
            v = base[i]
            known = out[:, : i - 1] @ v[: i - 1]
            out[:, i - 1] = ((squares[:, 0] - squares[:, i] + v @ v) / 2 - known) / v[i - 1]
        rest = squares[:, 0] - (out[:, : n - 1] ** 2).sum(axis=1)
        out[:, n - 1] = np.sqrt(np.maximum(rest, 0.0))
        return out

    def apexes(self, x: np.ndarray) -> np.ndarray:
        return self._apex(self.base, np.sqrt(squared(x, self.pivots).astype(float)))


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex):
    """(cluster, squared distance, pairs compared) of each row of `x`, exactly.

    A centroid is compared only if its lower bound is not above the least upper bound.
    """
    tops = simplex.apexes(centroids)
    a, h, c, g = apexes[:, :-1], apexes[:, -1:], tops[:, :-1], tops[:, -1]
    flat = np.maximum((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * a @ c.T, 0.0)
    size = (apexes**2).sum(1)[:, None] + (tops**2).sum(1)
    lower, upper = flat + (h - g) ** 2, flat + (h + g) ** 2
    least = (upper + SLACK * size).min(axis=1, keepdims=True)
    row, number = np.nonzero(lower - SLACK * size - 1 <= least)
    distance = np.empty(len(row), np.int64)
    for first in range(0, len(row), 1 << 17):
        part = slice(first, first + (1 << 17))
        distance[part] = ((x[row[part]] - centroids[number[part]]) ** 2).sum(axis=1)
    order = np.lexsort((number, distance, row))
    head = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return number[head], distance[head], len(row)


def _moved(cached: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The floored means of the vectors nearest to each centroid. Tasks send sums."""
    k, width = centroids.shape

    def add(batches: Batches) -> Batches:
        total, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x").to_pylist(), width)
            cluster, _, _ = nearest(x, _apexes(b, simplex), centroids, simplex)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0)
            counts += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(counts)
        numbers = [np.repeat(held, width), np.tile(np.arange(width), len(held)), total[held].ravel(), np.repeat(counts[held], width)]
        yield pa.record_batch([pa.array(v, pa.int64()) for v in numbers], ["c", "j", "s", "n"])

    sums = bounded_batches(cached).mapInArrow(add, "c long, j long, s long, n long")
    totals = sums.groupBy("c", "j").agg(*[F.sum(F.col(v).cast("decimal(38,0)")).alias(v) for v in "sn"])
    moved = centroids.copy()
    for r in totals.collect():  # a row for each component of a centroid
        moved[r["c"], r["j"]] = int(r["s"]) // int(r["n"])
    return moved


def _apexes(b: pa.RecordBatch, simplex: Simplex) -> np.ndarray:
    raw = b"".join(b.column("apex").to_pylist())
    return np.frombuffer(raw, "<f8").reshape(b.num_rows, len(simplex.pivots))


def cluster(
    table: DataFrame,
    k: int = 40,
    rounds: int = 5,
    width: int = 64,
    scale: int = 256,
    seed: int = 2,
    pivots: int = 16,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid, per vector.

    Vectors with exactly `width` components, none null or not finite, take part as integers
    floor(`scale` * component). The `k` with the smallest sha256 of "seed:vec_id" begin as
    centroids; `rounds` times every vector goes to the nearest centroid and centroids move to
    the floored means; then vectors are assigned once more. All numbers are exact: bounds
    from distances to `pivots` pivots, which are cached with the vectors, only leave out
    centroids that cannot be nearest. `centroid` holds the components joined by commas.

    Rows are vectors of their own also where they are repeated; rows without vec_id come last
    among the beginnings, equal hashes in the order of their components. With fewer vectors
    than `k` there are fewer centroids, and without any no rows. A vector whose integers reach
    2^26 stops the job with a ValueError, as its distances may not fit a long.
    """
    spark = table.sparkSession
    kept = saved(whole_vectors(table, width, scale), "whole")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(name), _component_order(width)).limit(k).collect()
    centroids = matrix([bytes(r["x"]) for r in first], width)
    vec_id = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}"
    if not first:
        return spark.createDataFrame(
            [], f"{vec_id}, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
        )
    simplex = Simplex(centroids, pivots)

    def cache(b: pa.RecordBatch) -> pa.RecordBatch:
        apexes = simplex.apexes(matrix(b.column("x").to_pylist(), width))
        raw = pa.array([a.astype("<f8").tobytes() for a in apexes], pa.binary())
        return pa.record_batch([b.column("vec_id"), b.column("x"), raw], ["vec_id", "x", "apex"])

    cached = saved(map_rows(kept, cache, f"{vec_id}, x binary, apex binary"), "apexes")
    for _ in range(rounds):
        centroids = _moved(cached, centroids, simplex)

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(b.column("x").to_pylist(), width)
        number, distance, _ = nearest(x, _apexes(b, simplex), centroids, simplex)
        return pa.record_batch(
            [b.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
        )

    assigned = saved(map_rows(cached, assign, f"{vec_id}, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row a cluster
    total = sum(r["s"] for r in sums)
    facts = [(r["cluster"], r["s"], total, ",".join(map(str, centroids[r["cluster"]].tolist()))) for r in sums]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def _component_order(width: int) -> F.Column:
    """Sorts integers kept as little-endian bytes like lists of numbers."""
    digits = lambda i: F.concat(*[F.substring(F.col("x"), 4 * i + b, 1) for b in (4, 3, 2, 1)])
    number = lambda i: (F.conv(F.hex(digits(i)), 16, 10).cast("long") + (1 << 31)).bitwiseAND((1 << 32) - 1)
    return F.array(*[number(i) for i in range(width)])
