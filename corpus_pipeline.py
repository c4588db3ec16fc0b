"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept, written as Parquet and read again. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import compression_bands, hilbert_packing, perfect_hash_lines, winnowing
from frostline.llm.bitsliced_simhash import near_duplicates
from frostline.llm.queries import table, tokenizer
from frostline.llm.workspace import saved


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one struct, whose names meet no other."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rest = [c for c, name in zip(rest, docs.columns) if name not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *rest).alias("row"))


def _columns(docs: DataFrame, **new: F.Column) -> list[F.Column]:
    """The columns of `docs` from carried rows, but for new ones."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    return [new.get(c, own[c]).alias(c) for c in docs.columns]


def _named(docs: DataFrame) -> DataFrame:
    """Carried rows with `digest`, 128 bits of the text. Documents are known by doc_id and
    digest, so that rows without doc_id are documents, too."""
    return _carried(docs).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _same(doc_id: str, digest: str) -> F.Column:
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("digest").eqNullSafe(F.col(digest))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or lie outside the compression bands go."""
    found = compression_bands.quality(_carried(docs), keep=("doc_id", "text", "row"))
    return found.where("kept").select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one. A document that had words and is left
    without any goes."""
    found = perfect_hash_lines.dedup_lines(_carried(docs))
    words = F.rlike(F.col("kept"), F.lit("[^\\x20\\x09-\\x0D]"))
    n_chars = F.length("kept").cast("long")
    return found.where(words | (F.col("n_dropped") == 0)).select(*_columns(docs, text=F.col("kept"), n_chars=n_chars))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that SimHash links (three words, two bits) the one with the
    least doc_id stays. Rows that agree in doc_id and text are one document."""
    known = _named(docs)
    groups = near_duplicates(known.select("doc_id", "digest", "text"), words=3, radius=2, key=("doc_id", "digest"))
    first = _same("component.doc_id", "component.digest")
    stays = groups.where(first).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    stays = saved(stays.withColumnsRenamed({"doc_id": "d", "digest": "h"}), "stays")
    kept = known.join(stays, _same("d", "h"))
    once = kept.where("rows = 1").select(*_columns(docs))
    more = kept.where("rows > 1").dropDuplicates(["doc_id", "digest"]).select(*_columns(docs))
    return once.union(more)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with five per cent or more of their words in benchmark passages go."""
    known = _named(docs)
    named = known.select(F.struct("doc_id", "digest").alias("doc_id"), "text")
    found = winnowing.contamination(named, table(spark, sf_dir, "benchmark"))
    dirty = found.where("contaminated").select("doc_id.*").distinct().toDF("d", "h")
    return known.join(dirty, _same("d", "h"), "left_anti").select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens along the Hilbert curve, one row per piece."""
    pieces = hilbert_packing.pack(docs, tokenizer())
    return hilbert_packing.crc32_of(pieces).drop("pieces")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Compression ratios, fingerprints by 64-bit XXH and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
