"""Frost-free seasons."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.dates import calendar_day
from frostline.schema import FALL_MONTHS, SPRING_MONTHS


def season_lengths(frost_days: DataFrame) -> DataFrame:
    """Days from the last spring frost to the first fall frost.

    Takes (station, date) rows of frost days; gives (station, year, days) for
    the years that have both frosts, the fall one on a later day of the year.
    Both extremes are combined before the shuffle.
    """
    day = F.col("_day.day_of_year")
    month = F.col("_day.month")
    return (
        frost_days.select("station", calendar_day(F.col("date")).alias("_day"))
        .where(F.col("station").isNotNull() & F.col("_day").isNotNull())
        .groupBy("station", F.col("_day.year").alias("year"))
        .agg(
            F.max(F.when(month.between(*SPRING_MONTHS), day)).alias("_spring"),
            F.min(F.when(month.between(*FALL_MONTHS), day)).alias("_fall"),
        )
        .where(F.col("_fall") > F.col("_spring"))
        .select(
            "station",
            "year",
            (F.col("_fall") - F.col("_spring")).cast("double").alias("days"),
        )
    )
