"""SimHash near-duplicates, compared in vertical bit planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.components import components
from frostline.llm.workspace import map_rows, saved, text_rows, utf8

BITS = 64
_LANES = np.uint64(0x0101010101010101)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: bytes, words: int) -> list[bytes]:
    """Runs of words of a text in lower case (A-Z), repeats included, joined by one space.

    A text with fewer words is one shingle; a text without any has none.
    """
    found = data.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(found) - words] + 1)).tolist()
    ends = np.concatenate((gaps[words - 1 :], [len(joined)])).tolist()
    return [joined[a:b] for a, b in zip(starts, ends)]


def _majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    counts = np.zeros((8, 8), np.int64)
    for first in range(0, len(hashes), 255):  # byte lanes hold 255 at most
        part = hashes[first : first + 255]
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64)
            counts[:, bit] += np.frombuffer(lanes.tobytes(), np.uint8)
    over = 2 * counts.ravel() > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprint(data: bytes | None, words: int) -> int:
    """The SimHash of a text; zero if it is null or has no words."""
    found = shingles(data or b"", words)
    if not found:
        return 0
    hashed = map(lambda s: xxhash.xxh64_intdigest(s, 42), found)
    return _majority(np.fromiter(hashed, np.uint64, len(found)))


def fingerprints(docs: DataFrame, words: int = 3, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and `fp`, the fingerprint as a signed long, of every row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter(
            (fingerprint(t, words) for t in utf8(b.column("text"))), np.uint64, b.num_rows
        )
        columns = [b.column(c) for c in key]
        return pa.record_batch([*columns, pa.array(fp.view(np.int64))], [*key, "fp"])

    rows = text_rows(docs, *key, "text")
    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key]
    return map_rows(rows, batch, ", ".join([*kept, "fp long"]))


# --- comparison of one block -------------------------------------------------------


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 of them to a word."""
    width = -(-len(fps) // 64)
    bits = np.zeros((BITS, width * 64), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(
        fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    ).T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class _Counters:
    """Distances of 64 lanes to a word, as bitwise counters with a sticky overflow."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.bits = [np.zeros(shape, np.uint64) for _ in range((radius + 1).bit_length())]
        self.over = np.zeros(shape, np.uint64)

    def add(self, level: int, value: np.ndarray) -> None:
        for k in range(level, len(self.bits)):
            value, self.bits[k] = self.bits[k] & value, self.bits[k] ^ value
        self.over |= value

    def add_three(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """A carry-save adder: three planes become one sum and one carry."""
        half = a ^ b
        carry = (a & b) | (half & c)
        self.add(0, half ^ c)
        if len(self.bits) > 1:
            self.add(1, carry)
        else:
            self.over |= carry

    def beyond(self) -> np.ndarray:
        """The lanes whose distance exceeds the radius."""
        more, same = np.zeros_like(self.over), np.full_like(self.over, _FULL)
        for k in reversed(range(len(self.bits))):
            if self.radius >> k & 1:
                same &= self.bits[k]
            else:
                more |= same & self.bits[k]
                same &= ~self.bits[k]
        return self.over | more

    def keep(self, alive: np.ndarray) -> None:
        self.bits = [x[alive] for x in self.bits]
        self.over = self.over[alive]


def close_pairs(fps: np.ndarray, radius: int, queries: int = 256):
    """Yields index arrays (i, j), i > j, of the fingerprints within the radius.

    Every fingerprint is compared with 64 others at a time. After each dozen of planes the
    words in which all lanes exceed the radius are abandoned.
    """
    planes = _planes(fps)
    width = planes.shape[1]
    for first in range(0, len(fps), queries):
        q = np.arange(first, min(first + queries, len(fps)))
        words = np.arange(min(width, (q[-1] >> 6) + 1))  # later lanes meet it as queries
        own, lane = (x.ravel() for x in np.meshgrid(q, words, indexing="ij"))
        counters = _Counters(own.shape, radius)
        for low in range(0, BITS, 3):
            differ = []
            for b in range(low, min(low + 3, BITS)):
                flip = np.where(fps[own] >> np.uint64(b) & np.uint64(1), _FULL, np.uint64(0))
                differ.append(planes[b][lane] ^ flip)
            if len(differ) == 3:
                counters.add_three(*differ)
            else:
                counters.add(0, differ[0])
            if low % 12 == 9 or low == 63:
                alive = counters.beyond() != _FULL
                if not alive.all():
                    own, lane = own[alive], lane[alive]
                    counters.keep(alive)
                if not len(own):
                    break
        if not len(own):
            continue
        hits = np.unpackbits(
            (~counters.beyond()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        at, bit = np.nonzero(hits)
        i, j = own[at], lane[at] * 64 + bit
        earlier = j < i
        yield i[earlier], j[earlier]


def block_labels(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a block, the index of the first of its component there."""
    label = np.arange(len(fps))
    for i, j in close_pairs(fps, radius):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    return label


# --- candidates --------------------------------------------------------------------


def _spread(free: list[int], parts: int) -> list[list[int]]:
    return [free[k::parts] for k in range(parts)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = 2, block: int = 8192) -> DataFrame:
    """(u, v): every distinct fingerprint that has another within the radius, in spanning
    links whose components are those of all such pairs.

    Two fingerprints within the radius agree in one of radius + 1 parts of their bits. The
    fingerprints of a part with the same value are one block and are compared bit-sliced.
    A block of more than `block` fingerprints is dealt again, by a part of the bits that
    are still free in it. Distinct fingerprints that agree in all but f bits are 2^f at
    most, so no block stays large, however alike the texts are. Nothing is left out.
    """
    values = saved(fps.select("fp").distinct(), "fingerprints")
    tables = [(k, p, -1) for k, p in enumerate(_spread(list(range(BITS)), radius + 1))]
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, found = values, []
    while True:
        probe = F.array(
            *[
                F.struct(
                    F.lit(k).alias("t"),
                    F.col("fp").bitwiseAND(F.lit(_signed(p))).alias("key"),
                    F.lit(parent).alias("of"),
                )
                for k, p, parent in tables
            ]
        )
        if "of" in rows.columns:
            dealt = rows.withColumn(
                "p", F.explode(F.filter(probe, lambda x: x["of"] == F.col("of")))
            )
        else:
            dealt = rows.withColumn("p", F.explode(probe))
        dealt = dealt.select("fp", "p.t", "p.key")
        sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = saved(sizes, "blocks")
        blocks = (
            dealt.join(sizes.where(F.col("n") <= block), ["t", "key"])
            .repartition(tasks, "t", "key")  # few bytes, but much to compare
            .groupBy("t", "key")
            .agg(F.collect_list("fp").alias("fps"))
            .select("fps")
        )
        found.append(saved(map_rows(blocks, lambda b: _block_links(b, radius), "u long, v long"), "close"))
        large = sizes.where(F.col("n") > block)
        if large.isEmpty():
            break
        # the free bits of a table that still has large blocks are parted once more
        free = {k: [b for b in range(BITS) if b not in p] for k, p, _ in tables}
        held = {k: p for k, p, _ in tables}
        rows = dealt.join(large.select("t", "key"), ["t", "key"]).select("fp", F.col("t").alias("of"))
        used = {r["t"] for r in large.select("t").distinct().collect()}  # as many as tables
        tables = [
            (n, held[k] + part, k)
            for n, (k, part) in enumerate(
                (k, part) for k in sorted(used) for part in _spread(free[k], radius + 1)
            )
        ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _block_links(b: pa.RecordBatch, radius: int) -> pa.RecordBatch:
    column = b.column("fps")
    values = column.flatten().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    u, v = [], []
    for a, z in zip(offsets[:-1], offsets[1:]):
        fps = np.sort(values[a:z])
        label = block_labels(fps.view(np.uint64).copy(), radius)
        moved = label != np.arange(len(fps))
        u.append(fps[moved])
        v.append(fps[label[moved]])
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v))
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = 2, block: int = 8192, key: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The key columns, `fp` and `component`, the struct of the least key in reach, of
    every row.

    Rows link when their fingerprints differ in `radius` bits or fewer. Texts without
    words have fingerprint zero and link like any other. Repeated rows keep one row each.
    Null keys come last, so they name a component only if no other key is in it. An empty
    table gives an empty result.
    """
    rows = saved(fingerprints(docs, words, key), "prints")
    roots = components(links(rows, radius, block))
    least = F.min(F.struct(*[F.struct(F.col(c).isNull().alias("no"), F.col(c).alias("is")).alias(c) for c in key]))
    by_print = rows.groupBy("fp").agg(least.alias("least"))
    named = by_print.join(roots, by_print["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = saved(named, "named")
    names = named.groupBy("root").agg(F.min("least").alias("first"))
    classes = named.join(names, "root").select(
        "fp", F.struct(*[F.col(f"first.{c}.is").alias(c) for c in key]).alias("component")
    )
    return rows.join(classes, "fp").select(*key, "fp", "component")
