"""Series packed into rows of points."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.values import NAN

# Characters of a date that name a span of the calendar: three are a decade.
SPAN_CHARACTERS = 3
KEYS = ("station_id", "station_name", "date")


def nest_series(
    rows: DataFrame,
    span_characters: int = SPAN_CHARACTERS,
    values: tuple[str, ...] | None = None,
) -> DataFrame:
    """Pack long-form rows into rows of sorted `points`, one per station and decade.

    A point is (date, *values), with NaN for a null `value`; without `values` they are all
    columns behind the date, so reports with overlays, with a fit or with neither are packed
    alike. `span` is the beginning of the dates of a row and `first_date` the first of them; the
    points of a station are those of its rows in the order of `span`. The calendar bounds an
    array, whatever the length of the series, and one shuffle packs them.
    """
    if values is None:
        values = tuple(c for c in rows.columns if c not in KEYS)
    columns = [F.coalesce(c, F.lit(NAN)).alias(c) if c == "value" else F.col(c) for c in values]
    return (
        rows.groupBy(
            "station_id", "station_name", F.substring("date", 1, span_characters).alias("span")
        )
        .agg(
            F.min("date").alias("first_date"),
            F.sort_array(F.collect_list(F.struct("date", *columns))).alias("points"),
        )
    )


def nest_days_and_fit(rows: DataFrame) -> DataFrame:
    """One row per station: `days`, its (date, value) points, and `fit`, the (date, value)
    points of the fitted curve, both by date. For reports with a row per year, which the
    calendar bounds; the curve of a station without a fit is empty."""
    day = F.struct("date", F.coalesce("value", F.lit(NAN)).alias("value"))
    fitted = F.when(F.col("fit").isNotNull(), F.struct("date", F.col("fit").alias("value")))
    return rows.groupBy("station_id", "station_name").agg(
        F.sort_array(F.collect_list(day)).alias("days"),
        F.sort_array(F.collect_list(fitted)).alias("fit"),
    )
