"""Quality rules from zstandard ratios: repetitive and incompressible texts are rejected."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from frostline.llm.workspace import map_partitions, text_rows, utf8


class Band(NamedTuple):
    """Ratios (bytes before / after) accepted from a length in bytes on."""

    length: int
    least: float
    most: float


#: Short texts compress badly, however they read, so limits widen with the length. Plain
#: prose lies well inside; base64 lies below, repeated phrases above.
WHOLE = (
    Band(0, 0.0, float("inf")),
    Band(64, 0.75, 2.5),
    Band(128, 0.9, 3.0),
    Band(256, 1.1, 3.5),
    Band(512, 1.2, 3.75),
    Band(1024, 1.35, 4.0),
    Band(4096, 1.35, 4.5),
    Band(16384, 1.35, 5.0),
)
CHUNK_BYTES = 2048
#: For a chunk; a rest of under 1024 bytes goes with the chunk before.
CHUNK = Band(CHUNK_BYTES, 1.3, 4.0)
#: Share of the bytes that may lie in chunks outside their band.
ODD_SHARE = 0.5
_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def accepted(length: int, ratio: float, bands: tuple[Band, ...] = WHOLE) -> bool:
    band = max(b for b in bands if b.length <= length)
    return band.least <= ratio <= band.most


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    """Chunks of `size` bytes that cover the text; a rest under half of it joins the last."""
    cuts = list(range(0, len(data), size))
    if len(cuts) > 1 and len(data) - cuts[-1] < size // 2:
        cuts.pop()
    return [data[a:z] for a, z in zip(cuts, [*cuts[1:], len(data)])]


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """The words that lie in a run of `width` words found twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter(
        (number.setdefault(w, len(number)) for w in words), np.uint64, len(words)
    )
    span = 1
    while span < width:  # codes of twice as many words, exact each time
        step = min(span, width - span)
        pairs = codes[:-step] << np.uint64(32) | codes[step:]
        codes = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        span += step
    twice = np.bincount(codes.astype(np.int64))[codes.astype(np.int64)] > 1
    if not twice.any():
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    change[:n] += twice
    change[width : width + n] -= twice
    return int((np.cumsum(change[:-1]) > 0).sum())


def measure(data: bytes, compress) -> tuple:
    """All figures of a text, in the order of COLUMNS."""
    text, words = data.decode(), data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_repeat = repeated_words(words)
    failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    ratio = len(data) / len(compress(data)) if data else 0.0
    parts = chunks(data) if len(data) >= CHUNK_BYTES else []
    ratios = [len(p) / len(compress(p)) for p in parts]
    odd = sum(len(p) for p, r in zip(parts, ratios) if not CHUNK.least <= r <= CHUNK.most)
    kept = not failed and accepted(len(data), ratio) and odd <= ODD_SHARE * len(data)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        n_repeat,
        failed,
        kept,
        len(data),
        ratio,
        min(ratios, default=None),
        max(ratios, default=None),
        odd,
    )


COLUMNS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "n_bytes": pa.int64(),
    "ratio": pa.float64(),
    "least_chunk_ratio": pa.float64(),
    "most_chunk_ratio": pa.float64(),
    "odd_chunk_bytes": pa.int64(),
}
_SQL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), level: int = 3) -> DataFrame:
    """The columns `keep` and the figures of every text: one row per row, no shuffle.

    A text fails the base rules if it has under 20 words, or if more than 30 % of its words
    lie in 8-word runs found twice. `kept` is false then, if the whole text compresses more
    or less than WHOLE allows at its length, or if over ODD_SHARE of its bytes lie in
    chunks outside CHUNK. Texts under 64 bytes have no ratio limits, texts under a chunk no
    chunks (null ratios). A null text is an empty one: no words, ratio 0. Repeated rows and
    null ids are rows like others.
    """

    def make():
        compress = zstandard.ZstdCompressor(level=level).compress

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t or b"", compress) for t in utf8(b.column("text"))]
            found = [
                pa.array(column, kind)
                for column, kind in zip(zip(*rows) if rows else [[]] * len(COLUMNS), COLUMNS.values())
            ]
            return pa.record_batch([*[b.column(c) for c in keep], *found], [*keep, *COLUMNS])

        return batch

    rows = text_rows(docs, *dict.fromkeys([*keep, "text"]))
    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    found = [f"{c} {_SQL[kind]}" for c, kind in COLUMNS.items()]
    return map_partitions(rows, make, ", ".join([*kept, *found]))
