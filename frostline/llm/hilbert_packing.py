"""Packing along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.workspace import Batches, bounded_batches, map_partitions, saved, text_rows, utf8

#: Entries of the cache of a Python worker; beyond that it begins anew.
CACHE_WORDS = 900_000
PART_BYTES = 4_000_000
VECTOR, DIMENSIONS, ORDER = 256, 3, 16


#: A run of these after letters is a unit of its own. The apostrophe is not one of them.
_TAIL = b".,;:!?#$%&*|()-_/\""


class WordTokens(dict):
    """Token ids (little-endian 32 bits) of words between ASCII white space.

    The tokenizer drops white space and never looks across it, so a text's ids are those of
    its words in a row. What is left of a word without the punctuation after it, if it has
    composed letters only, is one unit; such units go to the tokenizer's model many at a
    time, without its normalising, which would leave them as they are. Any other word is
    encoded by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__()
        self.codec = Tokenizer.from_file(path)
        self.units = Tokenizer.from_file(path)
        self.units.normalizer = None
        self.units.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        vocabulary = self.codec.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.tails: dict[bytes, bytes] = {b"": b""}

    def encode(self, text: str) -> bytes:
        ids = self.codec.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn_bases(self, bases: list[bytes]) -> None:
        for first in range(0, len(bases), 2048):
            part = bases[first : first + 2048]
            text = b" ".join(part).decode()
            # without the places of tokens in the text, which nothing needs
            ids = np.array(self.units.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(last) != len(part):  # pragma: no cover - another kind of vocabulary
                self.update((x, self.encode(x.decode())) for x in part)
                continue
            raw, start = ids.tobytes(), 0
            for base, end in zip(part, last):
                self[base] = raw[start:end]
                start = end

    def learn(self, words: set[bytes]) -> None:
        bases, longer, other = set(), [], []
        for w in words:
            base = w.rstrip(_TAIL)
            if base.isalpha() and base.islower():  # ASCII letters
                unit = base
            else:
                text = base.decode()
                unit = None
                if text.isalpha() and max(text) < "\u0300":
                    lower = text.lower()
                    unit = lower.encode() if len(lower) == len(text) else None
            if unit is None:
                other.append(w)
                continue
            bases.add(unit)
            if unit != w:
                longer.append((w, unit, w[len(base) :]))
        self._learn_bases([x for x in bases if x not in self])
        tails = self.tails
        for w, unit, tail in longer:
            if tail not in tails:
                tails[tail] = self.encode(tail.decode())
            self[w] = self[unit] + tails[tail]
        for w in other:
            self[w] = self.encode(w.decode())
        if len(tails) > 10_000:
            self.tails = {b"": b""}

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Arrow splits about PART_BYTES of text at a time and finds the
        different words in it; each of these is looked up once, and those that the cache lacks
        are learned together. A-Z are lower-cased first, as the tokenizer would."""
        out, first = [], 0
        while first < len(texts):
            end, size = first, 0
            while end < len(texts) and size < PART_BYTES:
                size += len(texts[end])
                end += 1
            lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts[first:end]], pa.large_binary()).cast(pa.large_string()))
            words = lists.flatten().dictionary_encode()
            different = words.dictionary.cast(pa.large_binary()).to_pylist()
            ids = pa.array(self.looked_up(different), pa.large_binary()).take(words.indices)
            raw, starts = ids.buffers()[2], np.frombuffer(ids.buffers()[1], "<i8")
            raw = raw.to_pybytes() if raw is not None else b""
            edges = starts[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
            out += [raw[a:z] for a, z in zip(edges, edges[1:])]
            first = end
        return out

    def looked_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if len(self) > CACHE_WORDS:
            self.clear()
        ids = list(map(self.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            self.learn({words[i] for i in missing})
            for i in missing:
                ids[i] = self[words[i]]
        return ids


_worker: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """The tokenizer of a Python worker with its cache."""
    if path not in _worker:
        _worker[path] = WordTokens(path)
    return _worker[path]


def _projection(vector: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(7).normal(size=(vector, dimensions))


def document_points(vectors: np.ndarray, projection: np.ndarray, order: int) -> np.ndarray:
    """Integer coordinates below 2^order of vectors: unit length, projected, then spread so
    that most values lie inside the cube; what lies outside counts as its face."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    placed = vectors / np.where(norm == 0, 1, norm) @ projection
    scaled = (np.clip(placed, -4, 4) + 4) / 8 * ((1 << order) - 1)
    return scaled.astype(np.int64)


def hilbert_key(points: np.ndarray, order: int) -> np.ndarray:
    """The place of each point on the Hilbert curve of a cube with sides of 2^order."""
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    # Gray-code walk from the highest bit down: swap or invert the lower bits
    for bit in range(order - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for d in range(len(x)):
            turned = (x[d] & high) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else np.where(turned, x[0], x[0])
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for bit in range(order - 1, 0, -1):
        flip = np.where(x[-1] & (1 << bit), flip ^ ((1 << bit) - 1), flip)
    key = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for d in range(len(x)):
            key = key << 1 | ((x[d] ^ flip) >> bit & 1)
    return key


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`, `ids` (16 or 32 bits each, little-endian), `n` and Hilbert `key`."""

    def make():
        codec, projection = tokens_of(tokenizer), _projection(VECTOR, DIMENSIONS)
        end = np.array([end_id], "<u4").tobytes()
        bucket = np.random.default_rng(8).integers(0, VECTOR, max(len(codec.ends), end_id + 1))
        sign = np.random.default_rng(9).choice([-1.0, 1.0], VECTOR)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            vectors = np.zeros((b.num_rows, VECTOR))
            ids, n = [], []
            texts = utf8(b.column("text"))
            for first in range(0, len(texts), 1000):  # ids of a part of the batch at a time
                for raw in codec.texts([t or b"" for t in texts[first : first + 1000]]):
                    x = np.frombuffer(raw + end, "<u4")
                    vectors[len(n)] = np.bincount(bucket[x], minlength=VECTOR) * sign
                    wide = x.max() >= 1 << 16
                    ids.append(b"\x00" + x.tobytes() if wide else x.astype("<u2").tobytes())
                    n.append(len(x))
            key = hilbert_key(document_points(vectors, projection, ORDER), ORDER)
            return pa.record_batch(
                [*[b.column(c) for c in keep], pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(key)],
                [*keep, "ids", "n", "key"],
            )

        return batch

    rows = text_rows(docs, *dict.fromkeys([*keep, "text"]))
    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return map_partitions(rows, make, ", ".join([*kept, "ids binary, n long, key long"]))


def unpacked(ids: bytes) -> np.ndarray:
    """Ids as stored by `tokenised`: 16 bits each, or 32 after a zero byte (odd length)."""
    if len(ids) % 2:
        return np.frombuffer(ids, "<u4", offset=1)
    return np.frombuffer(ids, "<u2").astype("<u4")


def _starts(slim: DataFrame) -> DataFrame:
    """(row, first): where each document begins when all lie on the curve end to end.

    Rows are range-sorted by key and row. Each partition adds up its own lengths; then the
    totals of the partitions, one row each, give the place of the first.
    """

    def within(batches: Batches) -> Batches:
        total = 0
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(n)
            yield pa.record_batch(
                [b.column("row"), pa.array(ends - n), b.column("n")], ["row", "first", "n"]
            )
            total = int(ends[-1]) if len(ends) else total

    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    placed = saved(
        bounded_batches(ordered).mapInArrow(within, "row long, first long, n long").withColumn(
            "part", F.spark_partition_id()
        ),
        "placed",
    )
    totals = placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for r in totals:  # one row per partition
        bases += [F.lit(r["part"]), F.lit(base).cast("long")]
        base += r["n"]
    if not bases:
        return placed.select("row", "first")
    offset = F.create_map(*bases)[F.col("part")]
    return placed.select("row", (F.col("first") + offset).alias("first"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    length: int = 4096,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per piece: the columns `keep`, `start` (ids of the document before it),
    `length`, `doc_tokens`, `sequence_id`, `offset` (place in the sequence), `ids`, the
    piece's ids as little-endian 32 bits, and `pieces`, how many its document has.

    Documents lie along the curve in the order of their Hilbert keys, each followed by
    `end_id`, and are cut where a sequence of `length` ids is full: only the last one has
    padding, whatever the lengths. A document of any length is cut as often as needed. Null
    and empty texts are the end id alone. Equal texts have equal keys and lie next to one
    another, in the order of their rows; they are spread over partitions like others.
    """
    table = saved(
        tokenised(docs, tokenizer, end_id, keep).withColumn("row", F.monotonically_increasing_id()),
        "tokens",
    )
    placed = table.drop("key").join(_starts(table.select("row", "key", "n")), "row")
    names = [*keep]

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        owner, start, size, doc, seq, off, ids, parts = [], [], [], [], [], [], [], []
        firsts, raws = b.column("first").to_pylist(), b.column("ids")
        for at, first in enumerate(firsts):
            x = unpacked(raws[at].as_py())
            edges = [0, *range(length - first % length, len(x), length), len(x)]
            for a, z in zip(edges, edges[1:]):
                owner.append(at)
                start.append(a)
                size.append(z - a)
                doc.append(len(x))
                seq.append((first + a) // length)
                off.append((first + a) % length)
                ids.append(x[a:z].tobytes())
                parts.append(len(edges) - 1)
        at = pa.array(owner, pa.int64())
        numbers = [pa.array(x, pa.int64()) for x in (start, size, doc, seq, off)]
        return pa.record_batch(
            [*[b.column(c).take(at) for c in names], *numbers, pa.array(ids, pa.binary()), pa.array(parts, pa.int64())],
            [*names, "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "pieces"],
        )

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return map_partitions(
        placed.select(*names, "first", "ids"),
        lambda: cut,
        ", ".join([*kept, "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, pieces long"]),
    )


def crc32_of(pieces: DataFrame) -> DataFrame:
    """Replaces `ids` by their CRC-32 as `ids_crc32`, without another pass over texts."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


