"""Chat logs: snapshots that longer conversations continue are collapsed, then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _xor(expression: str, window) -> F.Column:
    return F.expr(f"bit_xor({expression})").over(window)


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """The turns with `n` (place), `h1` and `h2`, a rolling hash of all turns so far, and
    `last`. Turns are ordered by turn, then role and text.

    A turn's hash covers its place, so the running exclusive-or depends on the order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn(
        "n", F.row_number().over(order)
    )
    said = "n, role IS NULL, role, text IS NULL, text"
    return numbered.select(
        "conv_id",
        "n",
        "role",
        "text",
        _xor(f"xxhash64(1, {said})", so_far).alias("h1"),
        _xor(f"xxhash64(2, {said})", so_far).alias("h2"),
        F.lead("n").over(order).isNull().alias("last"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that begin no longer one.

    Of equal conversations the least conv_id stays, with their number. Rolling hashes of
    turn prefixes are distinct before they meet, so a common beginning is one row. A null
    conv_id is a conversation like others, the last among equals; null roles and texts
    equal only nulls.
    """
    prefixes = turn_prefixes(turns)
    key = ["n", "h1", "h2"]
    whole = prefixes.where("last").groupBy(*key).agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("no"), "conv_id")).alias("first"),
        F.count(F.lit(1)).alias("copies"),
    )
    begun = prefixes.where("NOT last").select(*key).distinct()
    return whole.join(begun, key, "left_anti").select(
        F.col("first.conv_id").alias("conv_id"), F.col("n").cast("long").alias("n_turns"), "copies"
    )


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and `chat`, the maximal conversations as one text each.

    A turn is `<|role|>`, a line break, the text and a line break; nulls are empty. Only
    turns of a conversation meet in a task; a conversation is one row of the result.
    """
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "c")
    chat = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda t: F.concat(
            F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n")
        ),
    )
    return (
        turns.select("conv_id", "turn", "role", "text")
        .join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
        .groupBy("conv_id", "n_turns", "copies")
        .agg(F.array_join(chat, "").alias("chat"))
    )
