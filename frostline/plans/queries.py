"""The reports: one function per query, observations in, a lazy DataFrame out.

Results are in long form: station_id, station_name, date, then the values.
Rows come in no particular order unless the docstring says otherwise; apply
`in_display_order` to what is shown to a reader.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.dates import (
    date_part,
    ordinal_day,
    period_of,
    water_year,
    year_number,
)
from frostline.operators.filters import above, at_or_below, of_datatype, of_station
from frostline.operators.long_series import BLOCK_ROWS, blocks_for, number_rows
from frostline.operators.names import Names, with_station_name
from frostline.operators.overlays import with_overlays, with_period_overlays
from frostline.operators.pairing import daily_mean_sums
from frostline.operators.polyfit import with_period_fit
from frostline.operators.rolling import block_rolling_mean
from frostline.operators.seasons import season_lengths
from frostline.schema import (
    FIRST_FIT_YEAR,
    FREEZING,
    STATION_NAMES,
    TREND_MIN_ROWS,
    TREND_WINDOW,
)
from frostline.sources.files import datatypes_listed, stations_listed


def in_display_order(result: DataFrame) -> DataFrame:
    """Series by station name, points by date."""
    return result.orderBy("station_name", "station_id", "date")


def _text(column: str) -> Column:
    """A missing station or date is shown as empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def stations(observations: DataFrame, names: Names = STATION_NAMES) -> DataFrame:
    """Every station with its friendly name, sorted by name."""
    found = (
        observations.select(F.col("station").alias("id"))
        .where(F.col("id").isNotNull())
        .distinct()
    )
    named = with_station_name(found, names, station="id")
    return named.select("id", F.col("station_name").alias("name")).orderBy("name", "id")


def datatypes(observations: DataFrame) -> DataFrame:
    """Every datatype that occurs, sorted."""
    return (
        observations.select("datatype")
        .where(F.col("datatype").isNotNull())
        .distinct()
        .orderBy("datatype")
    )


def stations_of_table(spark: SparkSession, path: str, names: Names = STATION_NAMES) -> DataFrame:
    """As `stations`, from the list that the load wrote beside the rows."""
    return stations(stations_listed(spark, path), names)


def datatypes_of_table(spark: SparkSession, path: str) -> DataFrame:
    """As `datatypes`, from the names of the table's folders."""
    return datatypes(datatypes_listed(spark, path))


def series(
    observations: DataFrame,
    datatype: str,
    station: str | None = None,
    window: int | None = None,
    low_pass: int | None = None,
    names: Names = STATION_NAMES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The daily values of one datatype, with a rolling mean and a low-pass.

    `window` and `low_pass` count rows; each overlay is null unless its width is above 1.
    Stations are smoothed in blocks of `block_rows` rows, which does not show in the result.
    """
    if not datatype:
        raise ValueError("datatype is required")
    rows = of_station(of_datatype(observations, datatype), station).select(
        _text("station").alias("station_id"), _text("date").alias("date"), "value"
    )
    rows = with_overlays(
        rows,
        "station_id",
        "date",
        "value",
        window,
        low_pass,
        block_rows,
    )
    return _named(rows, names, "value", "avg", "lpf")


def mean_temp_trend(
    observations: DataFrame,
    period: str,
    station: str | None = None,
    window: int | None = None,
    low_pass: int | None = None,
    names: Names = STATION_NAMES,
) -> DataFrame:
    """Monthly or yearly mean of the daily (TMAX + TMIN) / 2.

    Any period but "yearly" means monthly. `date` is the period; `window` and
    `low_pass` count periods.
    """
    if not period:
        raise ValueError("period is required")
    pairs = F.sum("pairs")
    means = (
        daily_mean_sums(of_station(observations, station))
        .groupBy(
            F.col("station").alias("station_id"),
            period_of(F.col("date"), period).alias("date"),
        )
        .agg(F.when(pairs > 0, F.sum("mean_sum") / pairs).alias("value"))
    )
    rows = with_period_overlays(means, "station_id", "date", "value", window, low_pass)
    return _named(rows, names, "value", "avg", "lpf")


def hot_days_per_year(
    observations: DataFrame,
    threshold: float,
    station: str | None = None,
    names: Names = STATION_NAMES,
) -> DataFrame:
    """Days per year with TMAX above `threshold`, and their quadratic trend.

    Years without such a day are absent. `fit` covers the years from 1980 on
    and is null elsewhere, and for stations with fewer than three such years.
    """
    if threshold is None:
        raise ValueError("threshold is required")
    days = (
        above(of_station(of_datatype(observations, "TMAX"), station), threshold)
        .groupBy(
            _text("station").alias("station_id"),
            period_of(_text("date"), "yearly").alias("date"),
        )
        .agg(F.count("value").cast("double").alias("value"))
    )
    year = year_number(F.col("date"))
    days = days.withColumn("_year", F.when(year >= FIRST_FIT_YEAR, year))
    fitted = with_period_fit(days, "station_id", "_year", "value", 2, "fit")
    return _named(fitted, names, "value", "fit")


def growing_season(
    observations: DataFrame,
    station: str | None = None,
    names: Names = STATION_NAMES,
) -> DataFrame:
    """Days between the last spring and the first fall frost, and a cubic trend.

    Years without both frosts are absent. `fit` covers the whole record and is
    null for stations with fewer than four seasons.
    """
    frost = at_or_below(of_station(of_datatype(observations, "TMIN"), station), FREEZING)
    seasons = season_lengths(frost).select(
        F.col("station").alias("station_id"),
        F.col("year").cast("string").alias("date"),
        F.col("year").cast("double").alias("_year"),
        F.col("days").alias("value"),
    )
    fitted = with_period_fit(seasons, "station_id", "_year", "value", 3, "fit")
    return _named(fitted, names, "value", "fit")


def climate_trend(
    readings: DataFrame,
    by: str | None = "station",
    date: str = "date",
    value: str = "value",
    window: int = TREND_WINDOW,
    min_rows: int = TREND_MIN_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Readings minus the mean of their day of the year, smoothed over years.

    Gives station_id, date, value, day_of_year, seasonal_mean, anomaly and
    long_term_trend: the centred mean of the anomaly over `window` rows, null
    with fewer than `min_rows` readings. `by=None` takes all rows as one series.
    """
    text = F.coalesce(F.col(date).cast("string"), F.lit(""))
    # one key for all rows, but no constant: that would bring them into one task
    key = F.substring(text, 1, 0) if by is None else F.coalesce(F.col(by), F.lit(""))
    rows = readings.select(
        key.alias("station_id"), text.alias("date"), F.col(value).cast("double").alias("value")
    )
    rows = _with_ordinal_day(number_rows(rows, "station_id", "date", "value"))
    # 366 means per station, from sums that are combined before their shuffle
    means = (
        _with_ordinal_day(
            readings.select(
                key.alias("station_id"), text.alias("date"), F.col(value).cast("double").alias("value")
            )
        )
        .where(F.col("day_of_year").isNotNull())
        .groupBy("station_id", "day_of_year")
        .agg(F.avg("value").alias("seasonal_mean"))
    )
    rows = _with_anomaly(rows.join(means, ["station_id", "day_of_year"], "left"))
    rows = blocks_for(rows, "station_id", "value", window, block_rows)
    rows = block_rolling_mean(
        rows, "station_id", "anomaly", window, block_rows, "long_term_trend", min_rows
    )
    return rows.select(
        "station_id", "date", "value", "day_of_year", "seasonal_mean", "anomaly", "long_term_trend"
    )


def _with_ordinal_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day_of_year", ordinal_day(date_part(F.col("date"))))


def _with_anomaly(rows: DataFrame) -> DataFrame:
    # A reading without a real date belongs to no day of the year.
    mean = F.when(F.col("day_of_year").isNotNull(), F.col("seasonal_mean"))
    return rows.withColumn("seasonal_mean", mean).withColumn(
        "anomaly", F.col("value") - F.col("seasonal_mean")
    )


def water_year_totals(
    observations: DataFrame,
    datatype: str = "PRCP",
    station: str | None = None,
    names: Names = STATION_NAMES,
) -> DataFrame:
    """Totals from 1 October to 30 September, `date` being the year of the end."""
    if not datatype:
        raise ValueError("datatype is required")
    totals = (
        of_station(of_datatype(observations, datatype), station)
        .select(
            _text("station").alias("station_id"),
            water_year(F.col("date")).alias("_year"),
            "value",
        )
        .where(F.col("_year").isNotNull())
        .groupBy("station_id", F.col("_year").cast("string").alias("date"))
        .agg(F.sum("value").alias("value"))
    )
    return _named(totals, names, "value")


def _named(rows: DataFrame, names: Names, *values: str) -> DataFrame:
    return with_station_name(rows, names).select(
        "station_id", "station_name", "date", *values
    )
