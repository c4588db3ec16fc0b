import pytest
from pyspark.sql import functions as F

from frostline.functions.dates import (
    calendar_day,
    date_part,
    is_leap_year,
    ordinal_day,
    period_of,
    water_year,
    year_number,
)


def evaluate(spark, function, inputs):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    rows = frame.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2000-01-01", (2000, 1, 1)),
        ("2001-02-28", (2001, 2, 59)),
        ("2001-03-01", (2001, 3, 60)),
        ("2001-12-31", (2001, 12, 365)),
        ("2000-02-28", (2000, 2, 59)),
        ("2000-02-29", (2000, 2, 60)),
        ("2000-03-01", (2000, 3, 61)),
        ("2000-12-31", (2000, 12, 366)),
        ("1900-03-01", (1900, 3, 60)),
        ("not-a-date", None),
        ("2000-13-01", None),
        ("2000-00-01", None),
        ("2000-01-00", None),
        ("2000-01-32", None),
        ("2000-01-1", None),
        ("", None),
        (None, None),
        # days are not checked against the month
        ("2001-02-31", (2001, 2, 62)),
        ("2001-06-31", (2001, 6, 182)),
        ("2001-07-01", (2001, 7, 182)),
        # separators and what follows are not checked
        ("2001/07.01", (2001, 7, 182)),
        ("2001-07-01T00:00:00", (2001, 7, 182)),
        # a plus sign is a number, a space is not
        ("2000-+1-+3", (2000, 1, 3)),
        ("2000-01- 3", None),
        ("2000-01--3", None),
        # text outside ASCII is not a date
        ("2000é01-01", None),
        ("٢٠٠٠-01-01", None),
    ],
)
def test_calendar_day(spark, text, expected):
    (day,) = evaluate(spark, calendar_day, [text])
    assert (None if day is None else tuple(day)) == expected


def test_calendar_day_agrees_with_the_calendar(spark):
    days = spark.range(0, 366 * 130).select(
        F.date_add(F.lit("1890-01-01").cast("date"), F.col("id").cast("int")).alias("d")
    )
    text = F.col("d").cast("string")
    wrong = days.where(
        (calendar_day(text).getField("day_of_year") != F.dayofyear("d"))
        | calendar_day(text).isNull()
    )
    assert wrong.count() == 0


def test_leap_years(spark):
    years = spark.createDataFrame([(y,) for y in (1900, 1999, 2000, 2004, 2100)], "y int")
    leap = [r.y for r in years.where(is_leap_year(F.col("y"))).collect()]
    assert leap == [2000, 2004]


def test_date_part_cuts_timestamps_and_leaves_dates(spark):
    given = ["1998-04-12T00:00:00", "2020-01-01", "2020"]
    assert evaluate(spark, date_part, given) == ["1998-04-12", "2020-01-01", "2020"]


@pytest.mark.parametrize(
    "period, expected", [("yearly", "1998"), ("monthly", "1998-04"), ("weekly", "1998-04")]
)
def test_any_period_but_yearly_is_monthly(spark, period, expected):
    assert evaluate(spark, lambda c: period_of(c, period), ["1998-04-12"]) == [expected]


def test_ordinal_day_needs_a_real_date(spark):
    given = ["2000-03-01", "2001-03-01", "2001-02-31", "x"]
    assert evaluate(spark, ordinal_day, given) == [61, 60, None, None]


def test_water_year_starts_in_october(spark):
    given = ["1999-09-30", "1999-10-01", "1999-12-31", "2000-01-01", "bad"]
    assert evaluate(spark, water_year, given) == [1999, 2000, 2000, 2000, None]


def test_year_number(spark):
    given = ["1980", "0099", "+199", "1e3", "19x0", " 199", "199f", "", None]
    assert evaluate(spark, year_number, given) == [
        1980.0, 99.0, 199.0, 1000.0, None, None, None, None, None,
    ]
