"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.workspace import map_partitions, map_rows, saved, text_rows, utf8

# A-Z become a-z; every other ASCII character but digits and letters parts words.
_WORDS = bytes(
    c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_WORDS).split()


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met last."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, made of the hashes of its words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, p in enumerate(_powers(k)):
        out += hashes[i : i + n] * p
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """The places that hold the least hash of a window of `window` grams; ties all count."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, window):
        np.minimum(least, grams[i : i + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for i in range(window):
        chosen[i : i + n] |= grams[i : i + n] == least
    return np.flatnonzero(chosen)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def benchmark_windows(items: DataFrame, span: int = 13, gram: int = 7) -> DataFrame:
    """The distinct windows of all items: `window` (its words), `n` (how many), `hash` and
    `at` (its least gram and where that starts), `ids` (the items that hold it, sorted).

    A window shorter than `span`, a whole short item, is its own gram.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        known = WordHashes()
        texts, sizes, hashes, places, ids = [], [], [], [], []
        for item, data in zip(b.column("item_id"), utf8(b.column("text"))):
            words = words_of(data)
            n = min(span, len(words))
            if not n:
                continue
            grams = gram_hashes(known.of(words), gram if n == span else n)
            for i in range(len(words) - n + 1):
                at = int(grams[i : i + span - gram + 1].argmin()) if n == span else 0
                texts.append(b" ".join(words[i : i + n]).decode())
                sizes.append(n)
                hashes.append(grams[i + at])
                places.append(at)
                ids.append(item)
        ids = pa.array([x.as_py() for x in ids], b.column("item_id").type)
        return pa.record_batch(
            [pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), _signed(np.array(hashes, np.uint64)), pa.array(places, pa.int32()), ids],
            ["window", "n", "hash", "at", "item_id"],
        )

    rows = text_rows(items, "item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()
    windows = map_rows(rows, batch, f"window string, n int, hash long, at int, item_id {kind}")
    return windows.groupBy("window", "n", "hash", "at").agg(
        F.array_sort(F.collect_set("item_id")).alias("ids")
    )


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """One bit for the low bits of each hash. Its size is fixed, whatever the benchmark."""
    words = (
        windows.groupBy(F.expr(f"shiftright(hash & {(1 << bits) - 1}L, 5)").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(hash & 31L AS int)))").alias("b"))
        .toPandas()
    )
    out = np.zeros(max(1, 1 << (bits - 5)), np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def fingerprint_rows(
    docs: DataFrame, windows: DataFrame, span: int = 13, gram: int = 7, bits: int = 22
) -> DataFrame:
    """One row per document: `row` (unique), `doc_id`, `n_words`, and `marks`, its winnowed
    grams that may be in the benchmark: hash, place and the words around.

    A document keeps the least gram of every `span - gram + 1` grams, so it shares a
    fingerprint with every window of `span` words it contains. The filter is a bitmap of
    2^bits places, sent to all tasks; it only saves rows, equality is tested later.
    """
    short = [r["n"] for r in windows.select("n").distinct().collect()]  # span at most
    short = sorted(n for n in short if n < span)
    spark = docs.sparkSession
    known_grams = spark.sparkContext.broadcast(_bitmap(windows, bits))
    mask = np.uint64((1 << bits) - 1)

    def make():
        known, bitmap = WordHashes(), known_grams.value

        def marks(words: list[bytes]):
            if not words:
                return
            hashes = known.of(words)
            for n in [*short, span]:
                grams = gram_hashes(hashes, gram if n == span else n)
                low = grams & mask
                there = bitmap[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32) & 1
                hits = np.flatnonzero(there)
                if n == span and len(hits):
                    hits = np.intersect1d(hits, winnowed(grams, span - gram + 1))
                before, after = (span - gram, span) if n == span else (0, n)
                for p in hits.tolist():
                    first = max(0, p - before)
                    around = b" ".join(words[first : p + after]).decode()
                    yield int(grams[p].view(np.int64)), n, p, p - first, around

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            counts, found = [], []
            for data in utf8(b.column("text")):
                words = words_of(data)
                counts.append(len(words))
                found.append(
                    [dict(zip(("hash", "n", "p", "before", "around"), m)) for m in marks(words)]
                )
            kind = pa.struct(
                [("hash", pa.int64()), ("n", pa.int32()), ("p", pa.int32()), ("before", pa.int32()), ("around", pa.string())]
            )
            return pa.record_batch(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(kind))],
                ["doc_id", "n_words", "marks"],
            )

        return batch

    rows = text_rows(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = "array<struct<hash:long,n:int,p:int,before:int,around:string>>"
    rows = map_partitions(rows, make, f"doc_id {kind}, n_words long, marks {marks}")
    return rows.withColumn("row", F.monotonically_increasing_id())


def hits(marked: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, start, n, ids): every place at which a document holds a window, word by word."""
    marks = marked.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    first = F.col("before") - F.col("at")
    words = F.slice(F.split("around", " "), first + 1, F.col("n"))
    return (
        marks.join(windows, ["hash", "n"])
        .where(first >= 0)
        .where(F.array_join(words, " ") == F.col("window"))
        .select("row", (F.col("p") - F.col("at")).alias("start"), "n", "ids")
    )


def contamination(
    docs: DataFrame, items: DataFrame, span: int = 13, gram: int = 7, percent: float = 5
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids of the items it holds a window of),
    spans (the merged hit runs, as word places), contaminated.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A
    document is contaminated if it has a hit and `percent` of its words or more are hit.
    Nulls and empty texts have no words; an item without words has no window. A null
    item_id names no item. Repeated rows are documents of their own.
    """
    windows = saved(benchmark_windows(items, span, gram), "windows")
    marked = saved(fingerprint_rows(docs, windows, span, gram), "marked")
    found = saved(hits(marked, windows), "hits")
    runs = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("runs")
    )
    one = lambda start, end: F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        "runs",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                one(F.try_element_at(acc, F.lit(-1))["start"], F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"])),
            ),
        ).otherwise(F.concat(acc, one(x["start"], x["end"]))),
    )
    runs = runs.select("row", merged.alias("spans"))
    # documents with the same groups of items are resolved once
    groups = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.xxhash64(F.to_json("ids")))).alias("combo")
    )
    sets = found.select(F.xxhash64(F.to_json("ids")).alias("g"), "ids").distinct()
    combos = (
        groups.select("combo").distinct().select("combo", F.explode("combo").alias("g"))
        .join(sets, "g")
        .select("combo", F.explode("ids").alias("id"))
        .groupBy("combo")
        .agg(F.array_sort(F.collect_set("id")).alias("items"))
    )
    # only documents with hits meet their items, in tables that Spark can split by size
    named = groups.join(saved(combos, "combos"), "combo").select("row", "items")
    n_hit = F.aggregate(
        F.coalesce("spans", empty), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]
    )
    kind = items.schema["item_id"].dataType.simpleString()
    return (
        marked.select("row", "doc_id", "n_words")
        .join(runs, "row", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"),
            F.coalesce("spans", empty).alias("spans"),
        )
        .withColumn(
            "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
        )
    )
