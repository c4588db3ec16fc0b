"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import compression_bands, hilbert_packing, perfect_hash_lines, winnowing
from frostline.llm.bitsliced_simhash import near_duplicates
from frostline.llm.brown_clusters import brown_scores
from frostline.llm.compact_windows import near_passages
from frostline.llm.cross_polytope import nearest_neighbours
from frostline.llm.exact_substrings import dedup_substrings
from frostline.llm.importance_resampling import importance_resample
from frostline.llm.simplex_clusters import cluster
from frostline.llm.snapshot_collapse import rendered
from frostline.llm.wrapper_induction import main_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.quality(table(spark, sf_dir, "documents"))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = hilbert_packing.pack(table(spark, sf_dir, "documents"), tokenizer())
    return hilbert_packing.crc32_of(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op4_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), span=200)
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_bitsliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component.doc_id").alias("component_id"),
    )


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(table(spark, sf_dir, "documents")).drop("spans")


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


def op8_brown_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perfect_hash_lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op11_bitsliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op13_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, seed=2)
    return found.withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")


QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_hilbert_packing,
        op3_wrapper_induction,
        op4_induced_sorting,
        op5_bitsliced_simhash,
        op6_compact_windows,
        op7_snapshot_collapse,
        op8_brown_clusters,
        op9_winnowing,
        op10_perfect_hash_lines,
        op11_bitsliced_resampling,
        op12_cross_polytope,
        op13_simplex_clusters,
    )
}
