"""Line deduplication with a sharded minimal perfect hash over all distinct lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.workspace import Batches, bounded_batches, map_rows, saved, text_rows, utf8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = -(1 << 63)  # stands for a null doc_id
#: A line that more than 1 / HEAVY of all (line, document) rows hold is not sent to a
#: shard; there are HEAVY such lines at most.
HEAVY = 10_000


def line_key(line: bytes, least: int) -> bytes | None:
    """What a line is compared by; None if it has fewer than `least` characters."""
    key = line.strip().lower()
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return key


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


def line_rows(docs: DataFrame, least: int, without=None) -> DataFrame:
    """(lo, hi, doc_id): the 128-bit hash of every distinct line of every document, but
    those in `without`, a broadcast set."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        digests, owners = [], []
        left_out = without.value if without is not None else frozenset()
        for at, data in enumerate(utf8(b.column("text"))):
            keys = {line_key(x, least) for x in (data or b"").split(b"\n")}
            keys.discard(None)
            own = [d for d in map(_digest, keys) if d not in left_out]
            digests += own
            owners += [at] * len(own)
        lo, hi = _halves(digests)
        doc = b.column("doc_id").take(pa.array(owners, pa.int64()))
        return pa.record_batch([pa.array(lo), pa.array(hi), doc], ["lo", "hi", "doc_id"])

    return map_rows(docs, batch, "lo long, hi long, doc_id long")


# --- the hash of one shard ---------------------------------------------------------


def _place(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
    h = (lo ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) * _ODD
    h ^= h >> np.uint64(31)
    h = (h + hi) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps n keys to 0..n-1: a key is placed at the first level where no other key meets
    it, and numbered by the set bits before its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        total = 0
        for words in levels:
            ranks = np.cumsum(np.bitwise_count(words).astype(np.int64))
            self.before.append(total + np.concatenate(([0], ranks[:-1])))
            total += int(ranks[-1])

    @classmethod
    def of(cls, lo: np.ndarray, hi: np.ndarray) -> PerfectHash:
        levels = []
        while len(lo):
            words = -(-2 * len(lo) // 64)
            at = _place(lo, hi, len(levels), words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            lo, hi = lo[left], hi[left]
        return cls(levels)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not put in, -1 or any number."""
        out = np.full(len(lo), -1, np.int64)
        open_ = np.arange(len(lo))
        for level, words in enumerate(self.levels):
            if not len(open_):
                break
            at = _place(lo[open_], hi[open_], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found = self.before[level][at >> 6] + below
            out[open_[there]] = found[there]
            open_ = open_[~there]
        return out


_SHARD = "shard int, levels array<binary>, prints binary, counts binary, last binary"


def build_shards(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash of its lines, and by their numbers 64-bit
    fingerprints, counts up to 255 and the greatest doc_id."""

    def build(batches: Batches) -> Batches:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        lo, hi = (table[c].to_numpy().view(np.uint64) for c in ("lo", "hi"))
        shard = table["shard"].to_numpy()
        n = np.minimum(table["n"].to_numpy(), 255).astype(np.uint8)
        last = table["last"].to_numpy()
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            index = PerfectHash.of(lo[own], hi[own])
            own = own[np.argsort(index.find(lo[own], hi[own]))]
            yield pa.record_batch(
                [
                    pa.array([s], pa.int32()),
                    pa.array([[x.tobytes() for x in index.levels]], pa.list_(pa.binary())),
                    *[pa.array([x[own].tobytes()], pa.binary()) for x in (hi, n, last)],
                ],
                ["shard", "levels", "prints", "counts", "last"],
            )

    dealt = counts.select(
        F.pmod("lo", F.lit(shards)).cast("int").alias("shard"), "lo", "hi", "n", "last"
    )
    return bounded_batches(dealt.repartitionById(shards, F.col("shard"))).mapInArrow(build, _SHARD)


def probe(lines: DataFrame, shards: DataFrame, n_shards: int, least_docs: int) -> DataFrame:
    """The (doc_id, lo, hi) of `lines` whose arrays say that the document loses the line.

    Lines go to their shard as rows of three numbers; there the arrays come first and the
    lines stream past them.
    """
    arrays = ["levels", "prints", "counts", "last"]
    first = shards.select(
        "shard", F.lit(0).alias("turn"), *arrays,
        *[F.lit(None).cast("long").alias(c) for c in ("lo", "hi", "doc_id")],
    )
    then = lines.select(
        F.pmod("lo", F.lit(n_shards)).cast("int").alias("shard"),
        F.lit(1).alias("turn"),
        F.lit(None).cast("array<binary>").alias("levels"),
        *[F.lit(None).cast("binary").alias(c) for c in arrays[1:]],
        "lo", "hi", "doc_id",
    )

    def look_up(batches: Batches) -> Batches:
        held = None
        for b in batches:
            shard = b.column("shard").to_numpy(zero_copy_only=False)
            turn = b.column("turn").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(shard) | np.diff(turn) | (turn[1:] == 0)) + 1
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
                if turn[a] == 0:
                    row = {c: b.column(c)[a].as_py() for c in ("shard", *arrays)}
                    held = (
                        row["shard"],
                        PerfectHash([np.frombuffer(x, np.uint64) for x in row["levels"]]),
                        np.frombuffer(row["prints"], np.uint64),
                        np.frombuffer(row["counts"], np.uint8),
                        np.frombuffer(row["last"], np.int64),
                    )
                    continue
                if held is None or held[0] != shard[a]:
                    continue  # no line of the shard was counted
                _, index, prints, counts, last = held
                part = b.slice(a, z - a)
                lo, hi, doc = (
                    part.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "doc_id")
                )
                at = index.find(lo.view(np.uint64), hi.view(np.uint64))
                known = at >= 0
                known[known] = prints[at[known]] == hi.view(np.uint64)[known]
                goes = known.copy()
                goes[known] = (counts[at[known]] >= least_docs) & (last[at[known]] != doc[known])
                if goes.any():
                    yield pa.record_batch(
                        [pa.array(doc[goes]), pa.array(lo[goes]), pa.array(hi[goes])],
                        ["doc_id", "lo", "hi"],
                    )

    together = first.unionByName(then).repartitionById(n_shards, F.col("shard"))
    return bounded_batches(together.sortWithinPartitions("shard", "turn")).mapInArrow(
        look_up, "doc_id long, lo long, hi long"
    )


def dedup_lines(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, shard_lines: int = 1 << 19
) -> DataFrame:
    """The columns of `docs` (doc_id and text among them) with `kept`, the text that stays,
    `n_lines` before and `n_dropped`.

    Lines are compared without white space at their ends and with A-Z in lower case. A
    line of `least_chars` characters or more that `least_docs` documents hold loses all its
    places except those in the greatest doc_id. A null or empty text is one empty line;
    other lines stay as they are. Rows are documents: a row that is repeated counts each
    time, and rows with the greatest doc_id all keep the line. A null doc_id is less than
    any other. The columns kept, n_lines and n_dropped of `docs`, if any, are replaced.
    """
    if not 1 <= least_docs <= 255:
        raise ValueError("least_docs must be from 1 to 255")
    spark = docs.sparkSession
    slim = text_rows(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), "text"
    )
    counts = saved(
        line_rows(slim, least_chars)
        .groupBy("lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")),
        "lines",
    )
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = {
        int(r["lo"]).to_bytes(8, "big", signed=True) + int(r["hi"]).to_bytes(8, "big", signed=True): r["last"]
        for r in counts.where((F.col("n") * HEAVY > total) & (F.col("n") >= least_docs)).collect()
    }
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct // shard_lines))
    shards = build_shards(counts, n_shards)
    common = spark.sparkContext.broadcast(frozenset(heavy))
    lines = line_rows(slim, least_chars, common)
    lost = (
        probe(lines, shards, n_shards, least_docs)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("lost"))
    )
    names = [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]
    joined = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
        .withColumn("doc_id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NONE)))
        .join(lost, "doc_id", "left")
        .select("row", "doc_id", "lost", F.col("row.text").alias("text"))
    )
    kept_by = spark.sparkContext.broadcast(heavy)

    def apply(b: pa.RecordBatch) -> pa.RecordBatch:
        lasts = kept_by.value
        kept, n_lines, n_dropped = [], [], []
        ids = b.column("doc_id").to_pylist()
        for doc, data, gone in zip(ids, utf8(b.column("text")), b.column("lost").to_pylist()):
            gone = {
                x["lo"].to_bytes(8, "big", signed=True) + x["hi"].to_bytes(8, "big", signed=True)
                for x in gone or ()
            }
            own = (data or b"").split(b"\n")
            stays = []
            for line in own:
                key = line_key(line, least_chars)
                if key is not None:
                    digest = _digest(key)
                    if digest in gone or lasts.get(digest, doc) != doc:
                        continue
                stays.append(line)
            kept.append(b"\n".join(stays).decode())
            n_lines.append(len(own))
            n_dropped.append(len(own) - len(stays))
        columns = [b.column("row"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        return pa.record_batch(columns, ["row", "kept", "n_lines", "n_dropped"])

    schema = f"row {joined.schema['row'].dataType.simpleString()}, kept string, n_lines long, n_dropped long"
    return map_rows(joined, apply, schema).select("row.*", "kept", "n_lines", "n_dropped")
