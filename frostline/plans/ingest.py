"""From raw files to the combined table, and what is missing in it."""

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.schema import FULL_PAGE
from frostline.sources.files import read_csv, replace_observations, write_trend

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class LoadReport:
    rows: int
    columns: list[str]
    path: str


def combine(observations: DataFrame, path: str) -> LoadReport:
    """Replace the combined table and report what was written. Until all is written, and if
    the job is lost, readers have the old table."""
    rows = replace_observations(observations, path)
    return LoadReport(rows, observations.columns, path)


def save_trend(trend: DataFrame, path: str) -> LoadReport:
    """Replace the table of a climate trend and report what was written."""
    return LoadReport(write_trend(trend, path), trend.columns, path)


def combine_csv(
    spark: SparkSession, folder: str, path: str, multi_line: bool = False
) -> LoadReport | None:
    """Stack all CSV files of a folder into one Parquet table.

    Rows are kept as they are, copies included. A folder without CSV files
    writes nothing and gives None.
    """
    observations = read_csv(spark, folder, multi_line)
    if observations is None:
        log.warning("no CSV files in %s", folder)
        return None
    report = combine(observations, path)
    log.info("%d rows of %s in %s", report.rows, report.columns, report.path)
    return report


def missing_years(
    observations: DataFrame, first_years: DataFrame, last_year: int
) -> DataFrame:
    """(station, year) from each first year to `last_year` without a reading.

    `first_years` has one row (station, first_year) per station.
    """
    observed = observations.select(
        "station", F.substring("date", 1, 4).try_cast("int").alias("year")
    ).distinct()
    expected = first_years.where(F.col("first_year") <= last_year).select(
        "station", F.explode(F.sequence("first_year", F.lit(last_year))).alias("year")
    )
    return expected.join(observed, ["station", "year"], "left_anti")


def unfinished_pages(pages: DataFrame, full_page: int = FULL_PAGE) -> DataFrame:
    """Full pages whose successor was never landed.

    A page with fewer rows than asked for is the last of its request; a full one
    calls for the page at the next offset. Takes (station, year, offset, rows).
    """
    following = pages.select(
        "station", "year", (F.col("offset") - full_page).alias("offset")
    )
    return (
        pages.where(F.col("rows") >= full_page)
        .join(following, ["station", "year", "offset"], "left_anti")
        .select("station", "year", "offset")
    )
