"""Nearest neighbours by inner product, through cross-polytope hashing with many probes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.vectors import padded, usable
from frostline.llm.workspace import Batches, bounded_batches, forget, map_rows, release, saved, text_rows

#: Vectors of a bucket that a batch of queries meets as one product of matrices.
BLOCK = 1024
#: Candidates a task holds before it leaves out those that others of the same query surpass.
HELD = 300_000
#: Bytes of the vectors that a task holds; neighbouring buckets with twice as many are parted.
CELL = 32 << 20
#: Candidates that queries may get if they go to all their cells at once.
AT_ONCE = 4_000_000
#: Queries whose true neighbours set the number of probes, and the share of these to be found.
SAMPLE, RECALL = 100, 0.95


def encoded(table: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, `v` (the components as bytes), `key` (128 bits of these), `norm` and `dim` of
    each vector that takes part, and the kind of number in `v`."""
    rows = text_rows(table, "vec_id", "embedding").where(F.col("vec_id").isNotNull())
    kind = "<f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        at, starts, lengths, x = usable(b.column("embedding"))
        x = x + 0.0  # one zero
        raw, norm, held = [], [], []
        for row, start, n in zip(at.tolist(), starts.tolist(), lengths.tolist()):
            v = x[start : start + n]
            top = np.abs(v).max()
            if top > 0:
                held.append(row)
                raw.append(v.astype(kind).tobytes())
                norm.append(float(top * math.sqrt(((v / top) ** 2).sum())))
        keys = [hashlib.md5(v).digest() for v in raw]
        dims = [len(v) // int(kind[2]) for v in raw]
        return pa.record_batch(
            [b.column("vec_id").take(pa.array(held, pa.int64())).cast(pa.int64()), pa.array(raw, pa.binary()),
             pa.array(keys, pa.binary()), pa.array(norm, pa.float64()), pa.array(dims, pa.int32())],
            ["vec_id", "v", "key", "norm", "dim"],
        )

    return map_rows(rows, batch, "vec_id long, v binary, key binary, norm double, dim int"), kind


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


class CrossPolytope:
    """Tables of hashes of unit vectors.

    A hash rotates the vector (three rounds of random signs and Hadamard transform) and takes
    the signed axis that is nearest. A bucket is a number of `bits` bits: as many whole hashes
    as go into it, and one over a part of the axes for the bits left. Probes of a query are the
    buckets whose axes have the greatest sums of its coordinates, over all tables together.
    """

    def __init__(self, dim: int, top_norm: float, even: bool, bits: int, tables: int):
        self.dim, self.top, self.even, self.tables = dim, top_norm, even, tables
        self.width = 1 << max(0, (dim + (not even) - 1).bit_length())
        whole = self.width.bit_length()
        self.axes = [self.width] * (bits // whole) + ([1 << (bits % whole - 1)] if bits % whole else [])
        self.buckets = 1 << bits
        pick = np.random.default_rng(12)
        self.signs = [[pick.choice([-1.0, 1.0], (3, self.width)) for _ in self.axes] for _ in range(tables)]

    def _units(self, x: np.ndarray, query: bool) -> np.ndarray:
        """On the sphere: with one more component, inner products order as angles do, whatever
        the lengths; where all vectors are equally long, without it."""
        out = np.zeros((len(x), self.width))
        out[:, : self.dim] = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.top)
        if not query and not self.even:
            out[:, self.dim] = np.sqrt(np.maximum(0.0, 1 - (out**2).sum(axis=1)))
        return out

    def _rotated(self, units: np.ndarray, table: int):
        for axes, signs in zip(self.axes, self.signs[table]):
            y = units
            for s in signs:
                y = hadamard(y * s)
            yield y[:, :axes]

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        units, out = self._units(x, False), np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for y in self._rotated(units, t):
                axis = np.abs(y).argmax(axis=1)
                negative = y[np.arange(len(y)), axis] < 0
                out[:, t] = out[:, t] * (2 * y.shape[1]) + 2 * axis + negative
        return out

    def probes(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(tables, buckets) of the `n` best probes of each query, best first."""
        units, tables, buckets, sums = self._units(x, True), [], [], []
        for t in range(self.tables):
            code, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for y in self._rotated(units, t):
                both = np.stack([y, -y], axis=2).reshape(len(y), -1)
                code = (code[:, :, None] * both.shape[1] + np.arange(both.shape[1])).reshape(len(x), -1)
                total = (total[:, :, None] + both[:, None, :]).reshape(len(x), -1)
                # the best sums have among the best sums of the hashes so far
                code, total = _best(n, total, code)
            tables.append(np.full(code.shape, t))
            buckets.append(code)
            sums.append(total)
        total, table, bucket = (np.concatenate(v, axis=1) for v in (sums, tables, buckets))
        order = np.argsort(-total, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(table, order, 1), np.take_along_axis(bucket, order, 1)


def _best(n: int, total: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`code` and `total` where the total is among the `n` greatest of its row."""
    if total.shape[1] <= n:
        return code, total
    at = np.argpartition(-total, n - 1, axis=1)[:, :n]
    return np.take_along_axis(code, at, 1), np.take_along_axis(total, at, 1)


def _chunks(n_rows: int, n_probes: int, width: int):
    """Parts of so many queries that their sums take some tens of megabytes."""
    step = max(1, (1 << 22) // (n_probes * 2 * width))
    return (slice(at, at + step) for at in range(0, n_rows, step))


def folded(rows: DataFrame, copies: int) -> DataFrame:
    """One row per different vector, with its `copies` smallest ids. Equal vectors are equally
    near to all others, so no more of them can be among that many."""
    once = rows.groupBy("key", "vec_id").agg(*[F.first(c).alias(c) for c in ("v", "norm", "dim")])
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    return (
        once.withColumn("place", place)
        .where(F.col("place") <= copies)
        .groupBy("key")
        .agg(*[F.first(c).alias(c) for c in ("v", "norm", "dim")], F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )


def _sample_truth(vectors: DataFrame, kind: str, sample: list, hashing: CrossPolytope, k: int) -> list:
    """(q, buckets): for each query of the sample, the buckets of its `k` nearest vectors,
    found among all."""
    queries = padded([bytes(r["v"]) for r in sample], kind, hashing.dim)
    own = {bytes(r["key"]): i for i, r in enumerate(sample)}

    def search(batches: Batches) -> Batches:
        best = np.full((len(queries), k), -np.inf)
        codes = np.zeros((len(queries), k, hashing.tables), np.int64)
        for b in batches:
            x = padded(b.column("v").to_pylist(), kind, hashing.dim)
            scores = queries @ x.T
            for row, key in enumerate(b.column("key").to_pylist()):
                if key in own:
                    scores[own[key], row] = -np.inf
            both = np.concatenate([best, scores], axis=1)
            at = np.argpartition(-both, k - 1, axis=1)[:, :k]
            used = np.unique(at[at >= k] - k)
            place = np.zeros(len(x), np.int64)
            place[used] = np.arange(len(used))
            hashes = hashing.hashes(x[used])
            new = np.take_along_axis(codes, np.minimum(at, k - 1)[:, :, None], 1)
            fresh = at >= k
            new[fresh] = hashes[place[at[fresh] - k]]
            best, codes = np.take_along_axis(both, at, 1), new
        q, j = np.nonzero(np.isfinite(best))
        lists = pa.array(codes[q, j].tolist(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(q), pa.array(best[q, j]), lists], ["q", "score", "buckets"])

    found = bounded_batches(vectors.select("key", "v")).mapInArrow(search, "q long, score double, buckets array<long>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    nearest = found.withColumn("place", place).where(F.col("place") <= k)
    return [(r["q"], r["buckets"]) for r in nearest.select("q", "buckets").collect()]


def probes_needed(vectors: DataFrame, kind: str, asked: DataFrame, hashing: CrossPolytope, k: int) -> int:
    """How many probes find the share RECALL of the neighbours of SAMPLE queries."""
    sample = asked.orderBy("key").limit(SAMPLE).select("key", "v").collect()
    truth = _sample_truth(vectors, kind, sample, hashing, k)
    everything = hashing.buckets * hashing.tables
    if not truth:
        return min(everything, hashing.tables)
    x = padded([bytes(r["v"]) for r in sample], kind, hashing.dim)
    of = [[buckets for own, buckets in truth if own == q] for q in range(len(x))]
    n = 64
    while True:
        n, rank = min(n, everything), []
        for part in _chunks(len(x), n, hashing.width):
            for q, (t, b) in enumerate(zip(*hashing.probes(x[part], n)), part.start):
                place = np.full(everything, everything)
                place[t * hashing.buckets + b] = np.arange(len(t))
                rank += [int(place[np.arange(hashing.tables) * hashing.buckets + codes].min()) for codes in of[q]]
        need = int(np.quantile(rank, RECALL, method="higher")) + 1
        if need <= n or n == everything:
            return min(need, everything)
        n *= 4


class Cells:
    """How the tables are cut into what a task holds: neighbouring buckets, as many as `low` bits tell
    apart, or one of several parts of these, dealt by key, if they have over `most` vectors.

    counts: how many vectors the buckets of each cell have, table by table.
    """

    def __init__(self, counts: np.ndarray, tables: int, low: int, most: int):
        self.low, self.of_table = low, len(counts) // tables
        self.parts = -(-counts // most)
        self.first = np.cumsum(self.parts) - self.parts
        self.number = int(self.parts.sum())

    def of(self, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return table * self.of_table + (bucket >> self.low)

    def within(self, bucket: np.ndarray) -> np.ndarray:
        return bucket & ((1 << self.low) - 1)


def cut_into_cells(hashed: DataFrame, hashing: CrossPolytope, n: int, row_bytes: int) -> Cells:
    """Cells of CELL bytes or fewer, and no fewer cells than partitions, if there are as many buckets."""
    parts = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = hashing.buckets.bit_length() - 1
    wanted = max(parts / hashing.tables, n * row_bytes / CELL, 1)
    high = min(bits, math.ceil(math.log2(wanted)))
    codes = hashed.select(F.posexplode("codes").alias("t", "b"))
    found = codes.groupBy("t", F.shiftright("b", bits - high).alias("c")).count().collect()
    counts = np.zeros(hashing.tables << high, np.int64)
    for r in found:
        counts[(r["t"] << high) + r["c"]] = r["count"]
    return Cells(counts, hashing.tables, bits - high, max(BLOCK, 2 * -(-n >> high)))


_SENT = "cell int, at long, key binary, v binary, ids array<long>, bits binary, bound double"
#: Queries stand behind the vectors of a cell.
_BEHIND = 1 << 62


def _entries(hashed: DataFrame, cells: Cells) -> DataFrame:
    """Every vector, for the cell that it is in in each table."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        codes = b.column("codes").flatten().to_numpy().reshape(b.num_rows, -1)
        which = cells.of(np.arange(codes.shape[1]), codes)
        own = np.frombuffer(b"".join(b.column("key").to_pylist()), "<u8")[::2].reshape(-1, 1)
        part = (own % cells.parts[which].astype(np.uint64)).astype(np.int64)
        row = pa.array(np.repeat(np.arange(b.num_rows), codes.shape[1]))
        columns = [pa.array((cells.first[which] + part).ravel(), pa.int32()), pa.array(cells.within(codes).ravel())]
        columns += [b.column(c).take(row) for c in ("key", "v", "ids")]
        return pa.record_batch([*columns, pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.float64())], _names(_SENT))

    return map_rows(hashed.select("key", "v", "ids", "codes"), batch, _SENT)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sent(asked: DataFrame, hashing: CrossPolytope, cells: Cells, kind: str, n: int, early: bool | None) -> DataFrame:
    """Every query once for each cell in which it probes buckets, with a bit for each of these.

    early: only the two cells that its best probes are in, or all others; None: all."""

    def pieces(b: pa.RecordBatch) -> Batches:
        x = padded(b.column("v").to_pylist(), kind, hashing.dim)
        for part in _chunks(len(x), n, hashing.width):
            t, code = hashing.probes(x[part], n)
            of = cells.of(t, code)
            sent = np.ones(of.shape, bool)
            if early is not None:
                second = np.take_along_axis(of, (of != of[:, :1]).argmax(axis=1)[:, None], 1)
                sent = ((of == of[:, :1]) | (of == second)) == early
            row, probe = np.nonzero(sent)
            flags = np.zeros((len(t), len(cells.parts), 1 << cells.low), bool)
            flags[row, of[row, probe], cells.within(code[row, probe])] = True
            row, which = np.nonzero(flags.any(axis=2) & (cells.parts > 0))
            bits = [x.tobytes() for x in np.packbits(flags[row, which], axis=1)]
            times = cells.parts[which]
            again = np.repeat(np.arange(len(row)), times)
            number = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            at = pa.array(row[again] + part.start)
            columns = [
                pa.array((cells.first[which][again] + number), pa.int32()), pa.array(np.full(len(again), _BEHIND)),
                b.column("key").take(at), b.column("v").take(at), pa.nulls(len(at), pa.list_(pa.int64())),
                pa.array(bits, pa.binary()).take(pa.array(again)), b.column("bound").take(at),
            ]
            yield pa.record_batch(columns, _names(_SENT))

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield from pieces(b)

    return bounded_batches(asked.select("v", "key", "bound")).mapInArrow(run, _SENT)


def ranked(row: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates fewer than `k` others of their row surpass, ties to smaller ids, and their places."""
    order = np.lexsort((vec_id, -score, row))
    row, score, vec_id = row[order], score[order], vec_id[order]
    other = np.diff(row, prepend=-1) != 0
    worse = other | (np.diff(score, prepend=np.nan) != 0) | (np.diff(vec_id, prepend=-1) != 0)
    place = np.cumsum(worse)
    place -= np.repeat(place[other], np.diff(np.append(np.flatnonzero(other), len(row))))
    kept = place < k
    return order[kept], place[kept]


class Held:
    """The vectors of a cell, which queries meet bucket by bucket."""

    def __init__(self, rows: list[pa.RecordBatch], kind: str, dim: int, single: bool):
        self.kind, self.dim = kind, dim
        self.x = np.concatenate([padded(b.column("v").to_pylist(), kind, dim).astype(kind) for b in rows])
        self.rough = self.x if single else self.x.astype(float)
        self.keys = pa.concat_arrays([b.column("key") for b in rows])
        ids = pa.concat_arrays([b.column("ids") for b in rows])
        self.ids, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        self.starts, self.sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        at = np.concatenate([b.column("at").to_numpy() for b in rows])
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        self.blocks = [
            (int(at[i]), j, min(j + BLOCK, z))
            for i, z in zip(begins.tolist(), [*begins[1:].tolist(), len(at)])
            for j in range(i, z, BLOCK)
        ]
        norms = np.concatenate([np.linalg.norm(self.x[i : i + BLOCK].astype(float), axis=1) for i in range(0, len(at), BLOCK)])
        self.norms = [float(norms[i:j].max()) for _, i, j in self.blocks]
        # twice what rounding may add to a product, as a share of the lengths, and what it may lose in small numbers
        info = np.finfo(self.rough.dtype)
        self.share, self.tiny = (dim + 16) * float(info.eps), (dim + 16) * float(info.tiny)

    def exact(self, q: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores, added up in the order of the components, so that equal vectors have equal scores everywhere."""
        out = np.zeros(len(row))
        for i in range(0, len(row), 1 << 14):
            products = q[row[i : i + (1 << 14)]] * self.x[at[i : i + (1 << 14)]]
            out[i : i + len(products)] += np.add.accumulate(products, axis=1)[:, -1]
        return out

    def nearest(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The `k` nearest candidates of each query in the buckets that it probes here, but for those
        below its bound.

        A product of matrices leaves out what is clearly too far; the rest is scored exactly."""
        q = padded(queries.column("v").to_pylist(), self.kind, self.dim)
        raw = np.frombuffer(b"".join(queries.column("bits").to_pylist()), np.uint8).reshape(len(q), -1)
        probed = np.ascontiguousarray(np.unpackbits(raw, axis=1).T)
        bound = queries.column("bound").fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()
        lengths, rough = np.linalg.norm(q, axis=1), q.astype(self.rough.dtype)
        none = np.zeros(0, np.int64)
        kept, fresh, n = (none, none, np.zeros(0)), [], 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, at = (np.concatenate([p[i] for p in fresh] or [none]) for i in range(2))
            score = np.concatenate([kept[2], self.exact(q, row, at)])
            row, at = np.concatenate([kept[0], row]), np.concatenate([kept[1], at])
            fresh.clear()
            # the first id of a vector is its least
            best, place = ranked(row, score, self.ids[self.starts[at]], k)
            last = best[place == k - 1]
            bound[row[last]] = np.maximum(bound[row[last]], score[last])
            return row[best], at[best], score[best]

        for (bucket, i, j), norm in zip(self.blocks, self.norms):
            who = np.flatnonzero(probed[bucket])
            slack = self.share * lengths[who] * norm + self.tiny
            able = bound[who] <= lengths[who] * norm + slack
            who, slack = who[able], slack[able]
            if not len(who):
                continue
            scores = rough[who] @ self.rough[i:j].T
            bare = np.flatnonzero(np.isneginf(bound[who])) if j - i >= k else none
            if len(bare):
                least = np.partition(scores[bare], j - i - k, axis=1)[:, j - i - k]
                bound[who[bare]] = least - slack[bare]
            low = np.nextafter((bound[who] - slack).astype(scores.dtype), scores.dtype.type(-np.inf))
            row, at = np.nonzero(scores >= low[:, None])
            fresh.append((who[row], at + i))
            n += len(row)
            if n > max(HELD, len(kept[0])):
                kept, n = settled(), 0
        row, at, score = settled()
        times = self.sizes[at]
        pair = np.repeat(np.arange(len(row)), times)
        vec_id = self.ids[np.arange(len(pair)) - np.repeat(np.cumsum(times) - times - self.starts[at], times)]
        best, _ = ranked(row[pair], score[pair], vec_id, k)
        pair = pair[best]
        return pa.record_batch(
            [queries.column("key").take(pa.array(row[pair])), pa.array(-score[pair]), pa.array(vec_id[best]),
             self.keys.take(pa.array(at[pair]))],
            ["key", "far", "vec_id", "of"],
        )


def _candidates(asked: DataFrame, hashed: DataFrame, hashing: CrossPolytope, cells: Cells, kind: str, n: int, k: int, early: bool | None) -> DataFrame:
    """(key, far, vec_id, of): the best of each query and cell. A cell comes to one task, its vectors first."""
    dim, single = hashing.dim, kind == "<f4" and 1e-15 < hashing.top < 1e15

    def meet(batches: Batches) -> Batches:
        vectors: list[pa.RecordBatch] = []
        held = None
        for b in batches:
            n_vectors = b.column("bits").null_count
            if n_vectors:
                vectors.append(b.slice(0, n_vectors))
            if n_vectors < b.num_rows:
                held = held or Held(vectors, kind, dim, single)
                vectors.clear()
                yield held.nearest(b.slice(n_vectors), k)

    rows = _entries(hashed, cells).unionByName(_sent(asked, hashing, cells, kind, n, early))
    dealt = rows.repartitionById(cells.number, "cell").sortWithinPartitions("at").drop("cell")
    return bounded_batches(dealt).mapInArrow(meet, "key binary, far double, vec_id long, of binary")


def _search(asked: DataFrame, hashed: DataFrame, hashing: CrossPolytope, cells: Cells, kind: str, n: int, k: int) -> DataFrame:
    """(key, near): up to `k` candidates (minus score, vec_id, key) of each query, nearest first.

    A query goes once to each cell, with the buckets that it probes there. If these are many, it
    goes to two of them at first, and the score of the last of `k` candidates found there bounds what
    the others give."""

    def best(met: DataFrame) -> DataFrame:
        place = F.dense_rank().over(Window.partitionBy("key").orderBy("far", "vec_id", "of"))
        near = F.sort_array(F.collect_set(F.struct("far", "vec_id", "of")))
        return met.withColumn("place", place).where(F.col("place") <= k).groupBy("key").agg(near.alias("near"))

    told = asked.withColumn("bound", F.lit(None).cast("double"))
    if cells.number <= 4 or asked.count() * cells.number * k <= AT_ONCE:
        return best(_candidates(told, hashed, hashing, cells, kind, n, k, None))
    early = saved(best(_candidates(told, hashed, hashing, cells, kind, n, k, True)), "early")
    release(asked.sparkSession)
    bounds = early.where(F.size("near") >= k).select("key", (-F.col("near")[k - 1]["far"]).alias("bound"))
    rest = _candidates(asked.join(bounds, "key", "left"), hashed, hashing, cells, kind, n, k, False)
    return best(rest.unionByName(early.select("key", F.inline("near"))))


def nearest_neighbours(
    table: DataFrame, every: int = 20, k: int = 20, tables: int = 2, bucket_rows: int = 512
) -> DataFrame:
    """query_id, rank, vec_id and score: the `k` nearest rows found for each row whose vec_id is
    divisible by `every`, by inner product in double precision, ties to smaller vec_id.

    Every vector is in a bucket of each of `tables` tables; buckets hold `bucket_rows` vectors
    in the mean, whatever the size of the table. A query meets all vectors of the buckets it
    probes. Their number is set on SAMPLE queries so that RECALL of their true neighbours is
    found. Queries that find fewer than `k` probe more, up to all buckets.

    Vectors that are null, empty or zero, or hold null or not finite components, take no part,
    nor do rows without vec_id. Where lengths differ, missing components count as zero. Rows
    equal in id and vector count once; another vector of the same id is a candidate like any.
    Copies of a vector are searched once and answered by their smallest ids.
    """
    spark = table.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows, kind = encoded(table)
    vectors = saved(folded(rows, k + 1), "vectors")
    facts = vectors.agg(
        F.count("*").alias("n"), F.max("dim").alias("dim"), F.min("norm").alias("low"), F.max("norm").alias("high"),
        F.sum(F.size("ids")).alias("ids"),
    ).first()
    if not facts["n"]:
        return spark.createDataFrame([], result)
    row_bytes = facts["dim"] * int(kind[2])
    large = facts["n"] * row_bytes > CELL
    if large:
        release(spark)
    queries = encoded(table.where(F.col("vec_id") % every == 0))[0].select(F.col("vec_id").alias("query_id"), "key").distinct()
    asked = saved(vectors.join(queries.select("key").distinct(), "key", "left_semi"), "asked")
    bits = max(1, math.ceil(math.log2(facts["n"] / bucket_rows)))
    even = facts["high"] - facts["low"] <= 1e-6 * facts["high"]
    hashing = CrossPolytope(facts["dim"], facts["high"], even, bits, tables)
    n = probes_needed(vectors, kind, asked, hashing, k)

    def index(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = hashing.hashes(padded(b.column("v").to_pylist(), kind, hashing.dim))
        codes = pa.FixedSizeListArray.from_arrays(pa.array(hashes.ravel()), tables).cast(pa.list_(pa.int64()))
        return pa.record_batch([*(b.column(c) for c in ("key", "v", "ids")), codes], ["key", "v", "ids", "codes"])

    schema = "key binary, v binary, ids array<long>, codes array<long>"
    hashed = saved(map_rows(vectors.select("key", "v", "ids"), index, schema), "hashed")
    forget(vectors)
    cells = cut_into_cells(hashed, hashing, facts["n"], row_bytes)
    enough, everything, answers = min(k + 1, facts["ids"]), hashing.buckets * tables, []
    while True:
        found = saved(_search(asked, hashed, hashing, cells, kind, n, k + 1), "found")
        if large:
            release(spark)
        if n >= everything:
            answers.append(found)
            break
        full = found.where(F.size("near") >= enough)
        answers.append(full)
        asked, n = asked.join(full.select("key"), "key", "left_anti"), min(everything, 8 * n)
        if asked.isEmpty():
            break
    forget(hashed)
    every_answer = answers[0]
    for more in answers[1:]:
        every_answer = every_answer.unionByName(more)
    others = F.filter("near", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["of"] == F.col("key"))))
    return (
        queries.join(every_answer, "key")
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
    )
