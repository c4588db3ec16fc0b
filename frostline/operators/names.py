"""Friendly station names."""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.schema import STATION_NAMES

Names = Mapping[str, str] | DataFrame


def with_station_name(
    rows: DataFrame, names: Names = STATION_NAMES, station: str = "station_id"
) -> DataFrame:
    """Add `station_name`, falling back to the ID where no name is known.

    A mapping or a DataFrame (id, name) is left-joined without a hint: Spark broadcasts it
    only when its measured size allows that. An id with two rows would repeat results, so
    it stops the job.
    """
    if isinstance(names, DataFrame):
        twice = F.raise_error(F.concat(F.lit("two names for station "), F.col("id")))
        lookup = names.groupBy("id").agg(
            F.count(F.lit(1)).alias("_n"), F.min("name").alias("_name")
        ).select(
            F.col("id").alias("_id"), F.when(F.col("_n") > 1, twice).otherwise(F.col("_name")).alias("_name")
        )
    elif names:
        pairs = F.create_map(*[F.lit(text) for pair in names.items() for text in pair])
        one = rows.sparkSession.sql("SELECT 1")
        lookup = one.select(F.explode(pairs).alias("_id", "_name"))
    else:
        return rows.withColumn("station_name", F.col(station))
    return (
        rows.join(lookup, F.col(station) == F.col("_id"), "left")
        .withColumn("station_name", F.coalesce("_name", station))
        .drop("_id", "_name")
    )
