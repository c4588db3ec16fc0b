"""Landed API pages: JSON files with one response per line or per file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.dates import date_part
from frostline.schema import PAGE


def read_pages(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Pages as landed: station, year and offset asked for, and the results."""
    return (
        spark.read.schema(PAGE)
        .option("mode", "FAILFAST")
        .option("multiLine", one_per_file)
        .json(path)
    )


def page_observations(pages: DataFrame) -> DataFrame:
    """The records of all pages; timestamps are cut to their date.

    A page without results, or with an empty list, has no records.
    """
    return pages.select(F.explode("results").alias("r")).select(
        date_part(F.col("r.date")).alias("date"),
        F.col("r.datatype").alias("datatype"),
        F.col("r.station").alias("station"),
        F.col("r.value").alias("value"),
    )


def page_index(pages: DataFrame) -> DataFrame:
    """The number of records of each page."""
    return pages.select(
        "station",
        "year",
        "offset",
        F.coalesce(F.array_size("results"), F.lit(0)).alias("rows"),
    )
