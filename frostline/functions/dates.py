"""Column functions over date text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Four year digits, two month digits and two day digits around any two ASCII
# separators; a leading plus sign is a valid digit-field start. Text after the
# tenth character is ignored.
_DATE_TEXT = r"^([0-9]{4}|[+][0-9]{3})[\x00-\x7F]([0-9]{2}|[+][0-9])[\x00-\x7F]([0-9]{2}|[+][0-9])"

_NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def date_part(text: Column) -> Column:
    """The date of a timestamp text: its first ten characters."""
    return F.substring(text, 1, 10)


def period_of(date: Column, period: str) -> Column:
    """The year of a date for "yearly", its year and month for anything else."""
    return F.substring(date, 1, 4 if period == "yearly" else 7)


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def calendar_day(date: Column) -> Column:
    """(year, month, day_of_year) of a date text, null when it is not one.

    Days up to 31 are accepted in every month, so "2001-02-31" is day 62.
    """
    # try_cast, because ANSI mode raises on text that is not a number
    year = F.substring(date, 1, 4).try_cast("int")
    month = F.substring(date, 6, 2).try_cast("int")
    day = F.substring(date, 9, 2).try_cast("int")
    valid = date.rlike(_DATE_TEXT) & month.between(1, 12) & day.between(1, 31)
    first = F.dayofyear(F.make_date(year, F.when(valid, month).otherwise(1), F.lit(1)))
    return F.when(
        valid,
        F.struct(
            year.alias("year"),
            month.alias("month"),
            (first + day - 1).alias("day_of_year"),
        ),
    )


def ordinal_day(date: Column) -> Column:
    """Day of the year of a real date; null when the date does not exist."""
    return F.dayofyear(date.try_cast("date"))


def water_year(date: Column) -> Column:
    """The 1 October to 30 September year, named for the year it ends in."""
    real = date.try_cast("date")
    return F.year(real) + F.when(F.month(real) >= 10, 1).otherwise(0)


def year_number(text: Column) -> Column:
    """A year text as a double, null when it is not a number."""
    return F.when(text.rlike(_NUMBER_TEXT), text.try_cast("double"))
