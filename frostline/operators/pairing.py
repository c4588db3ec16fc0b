"""Daily highs matched with the lows of the same station and day."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.values import mean_of_extremes
from frostline.operators.filters import of_datatype


def _distinct_readings(rows: DataFrame, datatype: str, name: str) -> DataFrame:
    """Each distinct reading of a day once, with the number of its copies."""
    return (
        of_datatype(rows, datatype)
        .where(F.col("station").isNotNull() & F.col("date").isNotNull())
        .groupBy("station", "date", F.col("value").alias(name))
        .agg(F.count(F.lit(1)).alias(f"_{name}_copies"))
    )


def _crowded_days(high: DataFrame, low: DataFrame, side: int) -> DataFrame:
    """(station, date, _p, _q) of the days whose different highs and lows make more than
    side * side pairs, with the number of parts of either."""
    parts = [
        rows.groupBy("station", "date").agg(F.count(F.lit(1)).alias(name))
        for rows, name in ((high, "_p"), (low, "_q"))
    ]
    days = parts[0].join(parts[1], ["station", "date"]).where(F.col("_p") * F.col("_q") > side * side)
    return days.select(
        "station", "date", *[F.ceil(F.col(c) / side).cast("int").alias(c) for c in ("_p", "_q")]
    )


def _dealt(rows: DataFrame, days: DataFrame, value: str, own: str, other: str) -> DataFrame:
    """The readings of crowded days, each in one of its own parts and sent to all of the others'."""
    return (
        rows.join(days, ["station", "date"])
        .withColumn(own, F.pmod(F.xxhash64(value), F.col(own)))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .withColumn(other, F.col(other).cast("bigint"))
    )


def paired_days(observations: DataFrame, side: int = 1000) -> DataFrame:
    """Inner join of highs and lows on (station, date).

    Repeated readings multiply, as in any inner join. They are folded before
    the shuffle, and `copies` says how often a row of the join occurs. A day
    with p different highs and q lows has p * q rows; if these are more than
    side * side, highs and lows are dealt into parts of about `side` readings,
    and each two parts meet in a group of their own, so no task holds the day.
    """
    high = _distinct_readings(observations, "TMAX", "tmax")
    low = _distinct_readings(observations, "TMIN", "tmin")
    day = ["station", "date"]
    crowded = _crowded_days(high, low, side)
    plain = high.join(crowded, day, "left_anti").join(low, day, "inner")
    dealt = _dealt(high, crowded, "tmax", "_p", "_q").join(
        _dealt(low, crowded, "tmin", "_q", "_p"), [*day, "_p", "_q"], "inner"
    )
    return plain.unionByName(dealt.drop("_p", "_q")).select(
        "station",
        "date",
        "tmax",
        "tmin",
        mean_of_extremes(F.col("tmax"), F.col("tmin")).alias("mean_temp"),
        (F.col("_tmax_copies") * F.col("_tmin_copies")).alias("copies"),
    )


def daily_mean_sums(observations: DataFrame) -> DataFrame:
    """Per (station, date): sum and number of the daily means of all pairs.

    A day with p highs and q lows has p*q pairs, whose means add up to
    (q * sum(high) + p * sum(low)) / 2. One aggregate over one scan therefore
    replaces the join, and no pair is ever materialised. Days that lack a high
    or a low drop out; pairs with a null reading count as rows without a mean.
    """
    high = F.col("datatype") == "TMAX"
    low = F.col("datatype") == "TMIN"
    days = (
        observations.where(F.col("datatype").isin("TMAX", "TMIN"))
        .where(F.col("station").isNotNull() & F.col("date").isNotNull())
        .groupBy("station", "date")
        .agg(
            F.max(high).alias("_has_high"),
            F.max(low).alias("_has_low"),
            F.sum(F.when(high, F.col("value"))).alias("_high_sum"),
            F.sum(F.when(low, F.col("value"))).alias("_low_sum"),
            F.count(F.when(high, F.col("value"))).cast("double").alias("_highs"),
            F.count(F.when(low, F.col("value"))).cast("double").alias("_lows"),
        )
        .where("_has_high and _has_low")
    )
    pairs = F.col("_highs") * F.col("_lows")
    total = mean_of_extremes(
        F.col("_high_sum") * F.col("_lows"), F.col("_low_sum") * F.col("_highs")
    )
    return days.select(
        "station",
        "date",
        F.when(pairs > 0, total).alias("mean_sum"),
        pairs.alias("pairs"),
    )
