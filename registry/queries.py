"""Every query over the derived observation table.

Computed doubles are rounded to six digits, for comparison across engines.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

import frostline as fl
from frostline.functions.dates import calendar_day, ordinal_day, water_year
from frostline.operators.nesting import nest_series
from frostline.operators.pairing import paired_days
from frostline.operators.polyfit import polynomial_coefficients
from frostline.plans.ingest import combine, combine_csv, missing_years, unfinished_pages
from frostline.sources.files import read_observations, write_csv
from frostline.sources.pages import page_index, page_observations, read_pages
from frostline.sources.shared import shared_path
from registry.observations import observations, readings

Report = Callable[[DataFrame], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

CORVALLIS = "GHCND:USC00351862"
# The fixture has about 300 rows per station and year, so a page is short.
PAGE_ROWS = 50
OFF_TIES = 1.7e-8


def rounded(result: DataFrame) -> DataFrame:
    return result.select(
        *[
            F.round(f.name, 6).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f.name)
            for f in result.schema
        ]
    )


def on_observations(report: Report) -> Query:
    return lambda spark, sf_dir: rounded(report(observations(spark, sf_dir)))


def off_ties(trend: DataFrame) -> DataFrame:
    """Moves means off exact halves of the last digit compared, which engines round apart."""
    means = ("seasonal_mean", "anomaly", "long_term_trend")
    return trend.withColumns({c: F.col(c) + OFF_TIES for c in means})


def climate_trend_365(obs: DataFrame) -> DataFrame:
    highs = obs.where(F.col("datatype") == "TMAX")
    return off_ties(fl.climate_trend(highs, window=365, min_rows=182))


def climate_trend_all(obs: DataFrame) -> DataFrame:
    """One series of all readings of a datatype, with the default window of ten years."""
    return off_ties(fl.climate_trend(obs.where(F.col("datatype") == "TMAX"), by=None))


def calendar_days(obs: DataFrame) -> DataFrame:
    date = F.col("date")
    return (
        obs.groupBy("date")
        .agg(F.count(F.lit(1)).alias("readings"))
        .select(
            "date",
            calendar_day(date).getField("year").cast("int").alias("year"),
            calendar_day(date).getField("month").cast("int").alias("month"),
            calendar_day(date).getField("day_of_year").cast("int").alias("day_of_year"),
            ordinal_day(date).alias("ordinal_day"),
            water_year(date).alias("water_year"),
            "readings",
        )
    )


def season_line(obs: DataFrame) -> DataFrame:
    points = fl.growing_season(obs).select(
        "station_id", F.col("date").cast("double").alias("year"), "value"
    )
    return polynomial_coefficients(points, "station_id", "year", "value", 1)


def missing_station_years(obs: DataFrame) -> DataFrame:
    first = obs.select("station").distinct().withColumn("first_year", F.lit(1970))
    return missing_years(obs, first, 1990)


def points_of_nested_series(obs: DataFrame) -> DataFrame:
    return points_of_nested(fl.series(obs, "TMAX", window=30))


def points_of_nested(rows: DataFrame) -> DataFrame:
    """The points themselves, with their place in the row of their station and decade."""
    nested = nest_series(rows)
    return nested.select(
        "station_id", "station_name", "span", "first_date", F.posexplode("points").alias("place", "p")
    ).select("station_id", "station_name", "span", "first_date", "place", "p.*")


def points_of_days_and_fit(report: DataFrame) -> DataFrame:
    """The points of both lists, with their places."""
    nested = fl.nest_days_and_fit(report)
    lists = [
        nested.select(
            "station_id", "station_name", F.lit(part).alias("part"), F.posexplode(part).alias("place", "p")
        ).select("station_id", "station_name", "part", "place", "p.*")
        for part in ("days", "fit")
    ]
    return lists[0].unionByName(lists[1])


def decades_of_hot_days(obs: DataFrame) -> DataFrame:
    nested = nest_series(fl.hot_days_per_year(obs, 85.0))
    return nested.select(
        "station_id", "span", "first_date", F.posexplode("points").alias("place", "p")
    ).select("station_id", "span", "first_date", "place", "p.*")


def combine_csv_roundtrip(obs: DataFrame) -> DataFrame:
    spark = obs.sparkSession
    raw, combined = shared_path(spark, "csv"), shared_path(spark, "combined")
    write_csv(obs, raw)
    combine_csv(spark, raw, combined)
    return read_observations(spark, combined)


def combine_report(obs: DataFrame) -> DataFrame:
    """Rows and columns reported by the load, beside what was really written."""
    spark = obs.sparkSession
    report = combine(obs, shared_path(spark, "combined"))
    return read_observations(spark, report.path).agg(
        F.lit(report.rows).cast("long").alias("reported_rows"),
        F.lit(",".join(sorted(report.columns))).alias("columns"),
        F.count(F.lit(1)).alias("written_rows"),
    )


def replaced_table(obs: DataFrame) -> str:
    """A combined table that was loaded twice, the second time with all rows."""
    path = shared_path(obs.sparkSession, "combined")
    combine(obs.where("datatype = 'PRCP'"), path)
    combine(obs, path)
    return path


def trend_report(obs: DataFrame) -> DataFrame:
    """Rows and columns reported by the save of a trend, beside what was really written."""
    spark = obs.sparkSession
    trend = fl.climate_trend(obs.where("datatype = 'TMAX'"), window=365, min_rows=182)
    report = fl.save_trend(trend, shared_path(spark, "trend"))
    return fl.read_trend(spark, report.path).agg(
        F.lit(report.rows).cast("long").alias("reported_rows"),
        F.lit(",".join(sorted(report.columns))).alias("columns"),
        F.count(F.lit(1)).alias("written_rows"),
        F.count("long_term_trend").alias("smoothed_rows"),
    )


def landed_pages(obs: DataFrame) -> DataFrame:
    """The observations as API pages in JSON files, read back.

    A station has at most one reading per day and datatype here, so the calendar
    bounds the rows of a request.
    """
    request = Window.partitionBy("station", "year").orderBy("date", "datatype")
    record = F.struct(
        F.concat("date", F.lit("T00:00:00")).alias("date"), "datatype", "station", "value"
    )
    path = shared_path(obs.sparkSession, "pages")
    (
        obs.withColumn("year", F.substring("date", 1, 4).cast("int"))
        .withColumn("_page", F.floor((F.row_number().over(request) - 1) / PAGE_ROWS))
        .groupBy(
            "station", "year", (F.col("_page") * PAGE_ROWS + 1).cast("int").alias("offset")
        )
        .agg(F.collect_list(record).alias("results"))
        .write.json(path)
    )
    return read_pages(obs.sparkSession, path)


# Every report over a table of observations.
REPORTS: dict[str, Report] = {
    "observations": lambda o: o,
    "stations": fl.stations,
    "datatypes": fl.datatypes,
    "series_tmax": lambda o: fl.series(o, "TMAX"),
    "series_one_station": lambda o: fl.series(o, "TMIN", CORVALLIS),
    "series_rolling_30": lambda o: fl.series(o, "TMAX", window=30),
    "series_rolling_31": lambda o: fl.series(o, "TMAX", window=31),
    "series_rolling_365": lambda o: fl.series(o, "PRCP", window=365),
    "series_lowpass_30": lambda o: fl.series(o, "TMAX", low_pass=30),
    "series_both_overlays": lambda o: fl.series(o, "TMAX", window=31, low_pass=90),
    # small blocks, so that stations are cut on this small table too
    "series_blocks": lambda o: fl.series(o, "TMAX", window=31, low_pass=3, block_rows=250),
    # blocks shorter than the reach of the filter and than the window
    "series_lowpass_100000": lambda o: fl.series(o, "TMAX", low_pass=100_000, block_rows=250),
    "series_rolling_wide": lambda o: fl.series(
        o, "TMAX", window=801, low_pass=12, block_rows=250
    ).withColumn("avg", F.col("avg") + OFF_TIES),
    "climate_trend_wide": lambda o: off_ties(
        fl.climate_trend(o.where("datatype = 'TMAX'"), window=365, min_rows=182, block_rows=100)
    ),
    "series_nested": points_of_nested_series,
    "tmax_tmin_days": paired_days,
    "mean_temp_monthly": lambda o: fl.mean_temp_trend(o, "monthly"),
    "mean_temp_yearly": lambda o: fl.mean_temp_trend(o, "yearly"),
    "mean_temp_one_station": lambda o: fl.mean_temp_trend(o, "monthly", CORVALLIS),
    "mean_temp_monthly_smoothed": lambda o: fl.mean_temp_trend(
        o, "monthly", window=12, low_pass=6
    ),
    "hot_days_85": lambda o: fl.hot_days_per_year(o, 85.0).drop("fit"),
    "hot_days_fit_85": lambda o: fl.hot_days_per_year(o, 85.0),
    "hot_days_nested": decades_of_hot_days,
    "hot_days_and_fit": lambda o: points_of_days_and_fit(fl.hot_days_per_year(o, 85.0)),
    "growing_season_and_fit": lambda o: points_of_days_and_fit(fl.growing_season(o)),
    "growing_season": lambda o: fl.growing_season(o).drop("fit"),
    "growing_season_fit": fl.growing_season,
    "season_line": season_line,
    "climate_trend_365": climate_trend_365,
    "climate_trend_all": climate_trend_all,
    "water_year_precip": fl.water_year_totals,
    "calendar_days": calendar_days,
    "combine_csv_roundtrip": combine_csv_roundtrip,
    "combine_report": combine_report,
    "trend_report": trend_report,
    "table_replaced": lambda o: read_observations(o.sparkSession, replaced_table(o)),
    "table_stations": lambda o: fl.stations_of_table(o.sparkSession, replaced_table(o)),
    "table_datatypes": lambda o: fl.datatypes_of_table(o.sparkSession, replaced_table(o)),
    "ingest_pages": lambda o: page_observations(landed_pages(o)),
    "ingest_gaps": missing_station_years,
    "ingest_unfinished": lambda o: unfinished_pages(
        page_index(landed_pages(o)), PAGE_ROWS
    ),
}

# Reports over readings that repeat, are null, or leave a station without a fit.
REPEATED: dict[str, Report] = {
    "tmax_tmin_days_repeated": paired_days,
    # all readings of a year as those of one day, paired in parts
    "tmax_tmin_years_crowded": lambda o: paired_days(
        o.withColumn("date", F.substring("date", 1, 4)), side=4
    ),
    "mean_temp_repeated": lambda o: fl.mean_temp_trend(o, "monthly"),
    "series_rolling_repeated": lambda o: fl.series(o, "TMAX", window=51, block_rows=400),
    "series_lowpass_nulls": lambda o: fl.series(o, "TMAX", low_pass=30),
    "hot_days_no_fit": lambda o: fl.hot_days_per_year(o, 85.0),
    "growing_season_no_fit": fl.growing_season,
    "growing_season_no_curve": lambda o: points_of_days_and_fit(fl.growing_season(o)),
    "series_nested_nulls": lambda o: points_of_nested(fl.series(o, "TMAX")),
}


def on_readings(report: Report) -> Query:
    return lambda spark, sf_dir: rounded(report(readings(spark, sf_dir)))


QUERIES: dict[str, Query] = {n: on_observations(r) for n, r in REPORTS.items()} | {
    n: on_readings(r) for n, r in REPEATED.items()
}
