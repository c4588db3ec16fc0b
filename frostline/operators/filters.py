"""Row filters shared by the reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_datatype(rows: DataFrame, datatype: str) -> DataFrame:
    return rows.where(F.col("datatype") == datatype)


def of_station(rows: DataFrame, station: str | None) -> DataFrame:
    """Rows of one station; None keeps every station, "" is an ordinary ID."""
    return rows if station is None else rows.where(F.col("station") == station)


def above(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.where(F.col("value") > F.lit(float(threshold)))


def at_or_below(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.where(F.col("value") <= F.lit(float(threshold)))


def wants(overlay: int | None) -> bool:
    """An overlay is drawn only for a width above 1."""
    return overlay is not None and overlay > 1
