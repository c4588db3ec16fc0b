"""Importance resampling towards a target by hashed features, with bit-sliced weights."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.workspace import Batches, bounded_batches, map_partitions, saved, text_rows, utf8

#: Lower-cases A-Z and makes every other ASCII byte outside 0-9 and a-z a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
#: Bytes of a text that are split into words at a time, features known to a worker, documents
#: whose planes are held at once.
PIECE, KNOWN, CHUNK = 1 << 20, 500_000, 256


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte of it at a time."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Features(dict):
    """Buckets of features: runs of 1 to `longest` words, joined by a space."""

    def __init__(self, buckets: int, longest: int):
        super().__init__()
        self.buckets, self.longest = buckets, longest

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket

    def of(self, text: bytes) -> tuple[np.ndarray, int]:
        """The buckets of all features of a text, repeats included, and its number of words."""
        found, n_words, before = [], 0, []
        for words in words_of(text):
            n_words += len(words)
            found.append(np.array([self[w] for w in words], np.int64))
            for n in range(2, self.longest + 1):
                run = before[max(0, len(before) - n + 1) :] + words
                grams = (b" ".join(run[i : i + n]) for i in range(len(run) - n + 1))
                found.append(np.fromiter((self[g] for g in grams), np.int64))
            before = (before + words)[-(self.longest - 1) :] if self.longest > 1 else []
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), n_words


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall in each bucket. Each task sends its sums."""

    def count(batches: Batches) -> Batches:
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for b in batches:
            for text in utf8(b.column("text")):
                total += np.bincount(features.of(text or b"")[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    parts = bounded_batches(text_rows(texts, "text")).mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the source."""
    buckets = len(source)
    all_source, all_target = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def bit_planes(owners: np.ndarray, buckets: np.ndarray, counts: np.ndarray, n: int, width: int):
    """(j, rows, planes): for each bit j of the counts, the owners that have it in any bucket
    and a bitmap over buckets for each. `owners` and, within one, `buckets` ascend."""
    for j in range(int(counts.max(initial=0)).bit_length()):
        held = (counts >> j & 1).astype(bool)
        rows, row = np.unique(owners[held], return_inverse=True)
        word = row * width + (buckets[held] >> 6)
        bits = np.uint64(1) << (buckets[held] & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        planes = np.zeros(len(rows) * width, np.uint64)
        planes[word[first]] = np.bitwise_or.reduceat(bits, first)
        yield j, rows, planes.reshape(len(rows), width)


class GainPlanes:
    """Signed gains as bitmaps over buckets: one per bit, of the positive and of the negative."""

    def __init__(self, gains: np.ndarray):
        self.width = -(-len(gains) // 64)
        at = np.arange(len(gains))
        self.planes = [
            (sign << k, planes[0])
            for sign in (1, -1)
            for k, rows, planes in bit_planes(np.zeros_like(at), at, np.maximum(sign * gains, 0), 1, self.width)
            if len(rows)
        ]

    def sums(self, features: list[np.ndarray]) -> np.ndarray:
        """For each document, the sum of gains over its features: counts and gains meet as
        bitmaps, and what they have in common is counted and weighted by powers of two."""
        n, buckets = len(features), self.width * 64
        keys = np.concatenate([i * buckets + f for i, f in enumerate(features)] or [np.zeros(0, np.int64)])
        keys, counts = np.unique(keys, return_counts=True)
        total = np.zeros(n, np.int64)
        for j, rows, planes in bit_planes(keys // buckets, keys % buckets, counts, n, self.width):
            for weight, gain in self.planes:
                total[rows] += (weight << j) * np.bitwise_count(planes & gain).sum(axis=1, dtype=np.int64)
        return total


def _noise(doc_id: object, seed: int) -> int:
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_weights(
    docs: DataFrame, gains: np.ndarray, longest: int, seed: int, keep: tuple[str, ...]
) -> DataFrame:
    """The columns `keep`, n_words, n_features, weight and score of each document."""

    def make():
        features, planes = Features(len(gains), longest), GainPlanes(gains)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_features, sums = [], [], []
            texts = utf8(b.column("text"))
            for first in range(0, len(texts), CHUNK):
                held = [features.of(t or b"") for t in texts[first : first + CHUNK]]
                n_words += [w for _, w in held]
                n_features += [len(f) for f, _ in held]
                sums.append(planes.sums([f for f, _ in held]))
            n = np.array(n_features, np.int64)
            weight = np.concatenate(sums) // np.maximum(n, 1)
            noise = np.array([_noise(x, seed) for x in b.column("doc_id").to_pylist()], np.int64)
            numbers = [np.array(n_words, np.int64), n, weight, weight + noise]
            return pa.record_batch(
                [*[b.column(c) for c in keep], *map(pa.array, numbers)],
                [*keep, "n_words", "n_features", "weight", "score"],
            )

        return batch

    rows = text_rows(docs, *dict.fromkeys([*keep, "doc_id", "text"]))
    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return map_partitions(rows, make, ", ".join([*kept, "n_words long, n_features long, weight long, score long"]))


def _ranked(eligible: DataFrame, percent: int) -> DataFrame:
    """Adds `rank` to the `percent` percent of rows with the highest scores.

    Rows are sorted by ranges; the number of rows before each range, one row per partition,
    turns the place within it into a rank.
    """
    spark = eligible.sparkSession
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = eligible.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = saved(ordered.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    before, sizes = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        sizes.append((r["part"], before))
        before += r["count"]
    first = spark.createDataFrame(sizes, "part long, first long")
    rank = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.when(rank <= percent * before // 100, rank)
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(first), "part")
        .withColumn("rank", drawn)
        .drop("part", "first", "at")
    )


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    longest: int = 1,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns `keep` of every document, n_words, n_features, weight, score and rank.

    Features are runs of 1 to `longest` words, hashed into `buckets`. The weight is the mean
    log ratio (in thousandths) of the buckets' shares in `target` and in `docs`; with Gumbel
    noise of `seed` and doc_id added it is the score. Of the documents with `least_words` words,
    the `percent` percent with the highest scores are drawn without replacement and ranked.

    Null texts have no features and weight 0; a null doc_id makes noise as an empty one and
    comes first among equal scores. Rows that are repeated are drawn each by itself. Texts of
    any length are taken whole. Without target texts all shares of the target are equal.
    """
    gains = gains_of(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    names = dict.fromkeys(["doc_id", *keep])
    scored = saved(importance_weights(docs, gains, longest, seed, tuple(names)), "scored")
    enough = F.col("n_words") >= least_words
    ranked = _ranked(scored.where(enough), percent)
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(*[F.col(f"`{c}`") for c in keep], "n_words", "n_features", "weight", "score", "rank")
