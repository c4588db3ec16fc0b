"""Exact substring deduplication by suffix sorting of anchored segments."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.induced_sorting import repeats
from frostline.llm.workspace import Batches, bounded_batches, map_rows, saved, text_rows, utf8

GRAM = 40
_PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_MULTIPLIER, _PIECE + 4096)
_DOWN = _powers(pow(_MULTIPLIER, -1, 1 << 64), _PIECE + 4096)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups all strings of `span` bytes of a text by their anchor.

    The anchor of a string is the first of its least-hashed grams, so equal strings have
    it at the same place within. Returns where the strings of each anchor begin and end
    (first and last start), and the hash of its gram.
    """
    data, width = np.frombuffer(text, np.uint8), span - GRAM + 1
    total = len(data) - span + 1
    place, gram = [], []
    for first in range(0, max(total, 0), _PIECE):  # pieces, so that a place has 20 bits
        end = min(first + _PIECE, total)
        h = _gram_hashes(data[first : end + span - 1])
        chosen = _least(h & ~_LOW | np.arange(len(h), dtype=np.uint64), width) & _LOW
        chosen = chosen.astype(np.int64)
        place.append(chosen + first)
        gram.append(h[chosen])
    if not place:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64)
    place, gram = np.concatenate(place), np.concatenate(gram)
    first = np.flatnonzero(np.concatenate(([True], np.diff(place) != 0)))
    return first, np.concatenate((first[1:], [total])) - 1, gram[first]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of bytes, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


_RUN = pa.struct([("s", pa.int64()), ("e", pa.int64())])
_RUNS = pa.list_(_RUN)
_RUNS_SQL = "array<struct<s:long,e:long>>"


def _runs(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"s": int(a), "e": int(z)} for a, z in runs]


def _segments(docs: DataFrame, span: int) -> DataFrame:
    """A row for every text: `th` (MD5), `own`, the runs that the text repeats by itself,
    and its distinct segments: `a` (anchor), `seg` (hash of the bytes), `start`, `size`.

    A segment holds the strings of one anchor. Equal segments of a text cover one another.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        names, own, columns = [], [], {c: [] for c in ("a", "seg", "start", "size", "twice")}
        for data in utf8(b.column("text")):
            data = data or b""
            names.append(hashlib.md5(data).digest())
            first, last, gram = anchors(data, span)
            ends = last + span
            hashes = np.fromiter(
                (xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(first.tolist(), ends.tolist())),
                np.uint64,
                len(first),
            )
            _, at, inverse, n = np.unique(
                hashes, return_index=True, return_inverse=True, return_counts=True
            )
            more = np.flatnonzero(n[inverse] > 1)
            own.append(_runs(merged(list(zip(first[more].tolist(), ends[more].tolist())))))
            columns["a"].append(gram[at].view(np.int64))
            columns["seg"].append(hashes[at].view(np.int64))
            columns["start"].append(first[at].astype(np.int32))
            columns["size"].append((ends - first)[at].astype(np.int32))
            columns["twice"].append(n > 1)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        lists = [pa.array(v, pa.list_(k)) for v, k in zip(columns.values(), kinds)]
        return pa.record_batch(
            [pa.array(names, pa.binary()), pa.array(own, _RUNS), *lists], ["th", "own", *columns]
        )

    return map_rows(
        docs.select("text"),
        batch,
        f"th binary, own {_RUNS_SQL}, a array<long>, seg array<long>, start array<int>, "
        "size array<int>, twice array<boolean>",
    )


def _cut(rows: DataFrame) -> DataFrame:
    """The bytes of the wanted segments of each text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        a, seg, once, found = [], [], [], []
        for data, wanted in zip(utf8(b.column("text")), b.column("wanted").to_pylist()):
            for w in wanted:
                a.append(w["a"])
                seg.append(w["seg"])
                once.append(w["n"] == 1)
                found.append((data or b"")[w["start"] : w["start"] + w["size"]])
        return pa.record_batch(
            [pa.array(a, pa.int64()), pa.array(seg, pa.int64()), pa.array(once, pa.bool_()), pa.array(found, pa.binary())],
            ["a", "seg", "once", "bytes"],
        )

    return map_rows(rows, batch, "a long, seg long, once boolean, bytes binary")


def _sorted_block(segments: list[tuple], span: int) -> list[list[tuple[int, int]]]:
    """For each segment of a block, the runs whose strings stand in another of them."""
    sizes = np.array([len(s[3]) for s in segments])
    ends = np.cumsum(sizes + 1)  # a zero after each; no string that counts crosses it
    firsts = ends - sizes - 1
    text = np.frombuffer(b"".join(s[3] + b"\x00" for s in segments), np.uint8)
    starts = np.concatenate([np.arange(f, f + n - span + 1) for f, n in zip(firsts, sizes)])
    found = repeats(text, starts, span)
    out: list[list] = [[] for _ in segments]
    if len(found):
        cuts = np.flatnonzero(np.diff(found) > 1) + 1  # strings of two segments never adjoin
        begins = found[np.concatenate(([0], cuts))]
        lasts = found[np.concatenate((cuts - 1, [len(found) - 1]))]
        for k, s, e in zip(np.searchsorted(ends, begins, side="right"), begins, lasts):
            out[k].append((int(s - firsts[k]), int(e - firsts[k]) + span))
    return out


def _shared_runs(segments: DataFrame, span: int, block: int) -> DataFrame:
    """(a, seg, runs): what the segments of each anchor share with one another.

    Rows arrive by anchor. Whole anchors are gathered until a block is full, then sorted.
    """

    def scan(batches: Batches) -> Batches:
        held: list[tuple] = []
        size = 0

        def flush():
            rows = [
                (s, merged(runs)) for s, runs in zip(held, _sorted_block(held, span)) if s[2] and runs
            ]
            return pa.record_batch(
                [
                    pa.array([s[0] for s, _ in rows], pa.int64()),
                    pa.array([s[1] for s, _ in rows], pa.int64()),
                    pa.array([_runs(r) for _, r in rows], _RUNS),
                ],
                ["a", "seg", "runs"],
            )

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("a", "seg", "once", "bytes"))):
                if held and size >= block and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    return bounded_batches(segments).mapInArrow(scan, f"a long, seg long, runs {_RUNS_SQL}")


def _counted_runs(segments: DataFrame, span: int) -> DataFrame:
    """As _shared_runs, for anchors with very many segments: strings are counted by two
    64-bit hashes, so no task needs the segments of an anchor together."""

    def strings(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for a, seg, data in zip(*(b.column(c).to_pylist() for c in ("a", "seg", "bytes"))):
            for i in range(len(data) - span + 1):
                h = xxhash.xxh3_128_intdigest(data[i : i + span])
                out.append((a, seg, i, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
        columns = list(zip(*out)) or [[]] * 5
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "seg", "i", "h1", "h2"])

    rows = map_rows(segments, strings, "a long, seg long, i long, h1 long, h2 long")
    twice = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        rows.join(twice, ["h1", "h2"])
        .groupBy("a", "seg")
        .agg(F.collect_list(F.struct(F.col("i").alias("s"), (F.col("i") + span).alias("e"))).alias("runs"))
    )


def repeated_runs(
    docs: DataFrame, span: int = 200, block: int = 4 << 20, crowd: int = 20_000
) -> DataFrame:
    """(th, runs): for the MD5 of every text that has any, the bytes covered by a string of
    `span` bytes that also starts elsewhere in `docs`, as merged runs.

    Every string belongs to the segment of its anchor, and equal strings have equal
    anchors. Segments found twice or more are covered whole; they are counted by hash. The
    distinct segments that share an anchor are cut from one of their texts and brought
    together by anchor, where their suffixes are sorted. Over `crowd` segments of an anchor
    are compared by counting instead.
    """
    rows = text_rows(docs, "doc_id", "text")
    texts = saved(_segments(rows, span), "segments")
    each = texts.select(
        "th", F.explode(F.arrays_zip("a", "seg", "start", "size", "twice")).alias("x")
    ).select("th", "x.*")
    classes = saved(
        each.groupBy("a", "seg").agg(
            F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"),
            F.min(F.struct("th", "start", "size")).alias("at"),
        ),
        "classes",
    )
    crowds = classes.groupBy("a").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")
    )
    crowds = crowds.where("kinds > 1 AND single > 0").select("a", "kinds")
    wanted = (
        classes.join(crowds, "a")
        .select("a", "seg", "n", "kinds", "at.*")
        .groupBy("th")
        .agg(F.collect_list(F.struct("a", "seg", "n", "start", "size", "kinds")).alias("wanted"))
    )
    named = rows.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("th"))
    one = named.groupBy("th").agg(F.first("text").alias("text"))  # copies combine early
    cut = saved(
        _cut(one.join(wanted, "th").select("text", "wanted"))
        .join(crowds, "a"),
        "cut",
    )
    few = cut.where(F.col("kinds") <= crowd).select("a", "seg", "once", "bytes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = _shared_runs(few.repartition(parts, "a").sortWithinPartitions("a", "seg"), span, block)
    many = _counted_runs(cut.where(F.col("kinds") > crowd).select("a", "seg", "bytes"), span)
    partly = saved(few.union(many), "shared")
    whole = classes.where("n > 1").select("a", "seg", F.lit(None).cast(_RUNS_SQL).alias("runs"))
    covered = (
        each.select("th", "a", "seg", "start", "size")
        .join(whole.union(partly), ["a", "seg"])
        .select(
            "th",
            F.when(
                F.col("runs").isNull(),
                F.array(F.struct(F.col("start").cast("long").alias("s"), (F.col("start") + F.col("size")).cast("long").alias("e"))),
            )
            .otherwise(F.transform("runs", lambda r: F.struct((r["s"] + F.col("start")).alias("s"), (r["e"] + F.col("start")).alias("e"))))
            .alias("runs"),
        )
        .union(texts.where(F.size("own") > 0).select("th", F.col("own").alias("runs")))
    )
    return covered.groupBy("th").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def dedup_substrings(docs: DataFrame, span: int = 200, block: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, runs (removed bytes), kept (binary) per row.

    Each byte goes that a string of `span` bytes covers which also starts elsewhere, in the
    same text or another; strings are judged on the input, so equal ones all go. Texts are
    UTF-8; a null is empty. Repeated rows are texts of their own, so both lose all they
    share. Texts shorter than `span` stay.
    """
    runs = saved(repeated_runs(docs, span, block), "runs")
    rows = text_rows(docs, "doc_id", "text").withColumn(
        "th", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    )

    def apply(b: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, removed, spans, all_runs, kept = [], [], [], [], []
        for data, found in zip(utf8(b.column("text")), b.column("runs").to_pylist()):
            data = data or b""
            gone = merged([(r["s"], r["e"]) for r in found or ()])
            left, at = [], 0
            for s, e in gone:
                left.append(data[at:s])
                at = e
            left.append(data[at:])
            left = b"".join(left)
            n_bytes.append(len(data))
            removed.append(len(data) - len(left))
            spans.append(len(gone))
            all_runs.append(_runs(gone))
            kept.append(left)
        return pa.record_batch(
            [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)], pa.array(all_runs, _RUNS), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "runs", "kept"],
        )

    joined = rows.join(runs, "th", "left").select("doc_id", "text", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        joined, apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, runs {_RUNS_SQL}, kept binary"
    )
