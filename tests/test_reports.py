import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import frostline as fl
from frostline.operators.names import with_station_name
from frostline.operators.nesting import nest_series
from frostline.operators.pairing import _crowded_days, _dealt, _distinct_readings, paired_days
from frostline.plans.queries import in_display_order
from frostline.sources.files import from_rows

CORVALLIS, EUGENE = "GHCND:USC00351862", "GHCND:USW00024221"


@pytest.fixture(scope="module")
def small(spark):
    return from_rows(
        spark,
        [
            ("2000-01-01", "TMAX", EUGENE, 50.0),
            ("2000-01-01", "TMIN", EUGENE, 30.0),
            ("2000-01-02", "TMAX", EUGENE, 60.0),
            ("2000-02-01", "TMAX", EUGENE, 44.0),
            ("2000-02-01", "TMIN", EUGENE, 40.0),
            ("2000-01-01", "PRCP", "Z1", 0.5),
            ("2000-01-01", "TMAX", CORVALLIS, None),
            ("2000-01-01", "TMIN", CORVALLIS, 20.0),
            ("2000-01-01", None, None, 1.0),
        ],
    )


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_stations_by_name(small):
    assert rows(fl.stations(small), "id", "name") == [
        (CORVALLIS, "Corvallis"), (EUGENE, "Eugene"), ("Z1", "Z1"),
    ]


def test_datatypes_sorted(small):
    assert rows(fl.datatypes(small), "datatype") == [("PRCP",), ("TMAX",), ("TMIN",)]


def test_names_from_a_table_or_a_large_mapping(spark, small):
    table = spark.createDataFrame([("Z1", "Zed")], "id string, name string")
    assert rows(fl.stations(small, table), "name")[-1] == ("Zed",)
    large = {f"X{i}": f"name {i}" for i in range(2000)} | {"Z1": "Zed"}
    assert rows(fl.stations(small, large), "name")[-1] == ("Zed",)
    ids = spark.createDataFrame([("q",)], "station_id string")
    assert rows(with_station_name(ids, {}), "station_name") == [("q",)]


def test_series_filters(small):
    found = in_display_order(fl.series(small, "TMAX"))
    assert rows(found, "station_name", "date", "value") == [
        ("Corvallis", "2000-01-01", None),
        ("Eugene", "2000-01-01", 50.0),
        ("Eugene", "2000-01-02", 60.0),
        ("Eugene", "2000-02-01", 44.0),
    ]
    assert fl.series(small, "TMAX", EUGENE).count() == 3
    # empty text is an ordinary ID, and an unknown datatype has no rows
    assert fl.series(small, "TMAX", "").count() == 0
    assert fl.series(small, "SNOW").count() == 0


@pytest.mark.parametrize(
    "call",
    [
        lambda o: fl.series(o, ""),
        lambda o: fl.series(o, None),
        lambda o: fl.mean_temp_trend(o, ""),
        lambda o: fl.mean_temp_trend(o, None),
        lambda o: fl.hot_days_per_year(o, None),
    ],
)
def test_required_arguments(small, call):
    with pytest.raises(ValueError):
        call(small)


def test_mean_temp_needs_both_readings_of_a_day(small):
    found = fl.mean_temp_trend(small, "monthly").orderBy("station_name", "date")
    assert rows(found, "station_name", "date", "value") == [
        ("Corvallis", "2000-01", None),  # paired, but without a value
        ("Eugene", "2000-01", 40.0),
        ("Eugene", "2000-02", 42.0),
    ]
    yearly = fl.mean_temp_trend(small, "yearly", EUGENE)
    assert rows(yearly, "date", "value") == [("2000", 41.0)]
    assert fl.mean_temp_trend(small, "decade", EUGENE).count() == 2


def test_repeated_readings_multiply_as_in_the_join(spark):
    rng = random.Random(3)
    given = [
        (f"2000-01-{rng.randint(1, 9):02d}", rng.choice(["TMAX", "TMIN"]), s, v)
        for s in ("a", "b")
        for v in [rng.choice([None, 10.0, 20.0, 35.5]) for _ in range(60)]
    ]
    obs = from_rows(spark, given)
    frame = pd.DataFrame(given, columns=["date", "datatype", "station", "value"])
    high, low = (frame[frame.datatype == d] for d in ("TMAX", "TMIN"))
    joined = high.merge(low, on=["station", "date"])
    joined["mean"] = (joined.value_x + joined.value_y) / 2
    want = joined.groupby("station")["mean"].mean()
    found = {r.station_id: r.value for r in fl.mean_temp_trend(obs, "yearly").collect()}
    assert found.keys() == set(want.index)
    assert all(abs(found[s] - want[s]) < 1e-9 for s in found)
    pairs = paired_days(obs).agg(
        F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("mean_temp")).alias("t")
    )
    n, total = pairs.first()
    assert n == len(joined) and abs(total - joined["mean"].sum()) < 1e-9


def test_crowded_days_are_paired_in_parts(spark):
    """A day with many different highs and lows is dealt into groups of bounded size."""
    days = [("2000-01-01", 70, 40), ("2000-01-02", 3, 200), ("2000-01-03", 2, 2), ("2000-01-04", 50, 0)]
    given = [
        (date, name, s, v)
        for date, *counts in days
        for name, n in zip(("TMAX", "TMIN"), counts)
        for s in ("a", "b")
        for v in [None, *map(float, range(n)), 1.0]
        if n
    ]
    obs = from_rows(spark, given)
    key = ["station", "date", "tmax", "tmin", "mean_temp", "copies"]
    want = sorted(map(str, paired_days(obs, side=10**6).select(key).collect()))
    assert len(want) == 2 * (71 * 41 + 4 * 201 + 3 * 3)
    assert sorted(map(str, paired_days(obs, side=8).select(key).collect())) == want
    high, low = (_distinct_readings(obs, d, n) for d, n in (("TMAX", "tmax"), ("TMIN", "tmin")))
    crowded = _crowded_days(high, low, 8)
    assert {(r.date, r._p, r._q) for r in crowded.collect()} == {("2000-01-01", 9, 6), ("2000-01-02", 1, 26)}
    parts = _dealt(high, crowded, "tmax", "_p", "_q").groupBy("station", "date", "_p", "_q").count()
    assert parts.agg(F.max("count")).first()[0] < 24


def test_water_year_totals(spark):
    obs = from_rows(
        spark,
        [
            ("1999-09-30", "PRCP", "a", 1.0),
            ("1999-10-01", "PRCP", "a", 2.0),
            ("2000-09-30", "PRCP", "a", 4.0),
            ("2000-10-01", "PRCP", "a", 8.0),
            ("2000-10-01", "SNOW", "a", 16.0),
        ],
    )
    found = fl.water_year_totals(obs).orderBy("date")
    assert rows(found, "date", "value") == [("1999", 1.0), ("2000", 6.0), ("2001", 8.0)]


def climate(frame, window, min_rows):
    frame = frame.sort_values(["date", "value"]).reset_index(drop=True)
    day = pd.to_datetime(frame.date).dt.dayofyear
    frame["seasonal_mean"] = frame.groupby(day)["value"].transform("mean")
    frame["anomaly"] = frame.value - frame.seasonal_mean
    frame["long_term_trend"] = frame.anomaly.rolling(
        window, center=True, min_periods=min_rows
    ).mean()
    return frame


@pytest.mark.parametrize("block_rows", [10_000, 300])
@pytest.mark.parametrize("window, min_rows", [(31, 20), (365, 182), (400, 200)])
def test_climate_trend(spark, block_rows, window, min_rows):
    rng = random.Random(5)
    dates = [str(d.date()) for d in pd.date_range("1996-01-01", "1999-12-31")]
    # readings are missing, doubled and null
    days = [d for d in dates if rng.random() < 0.9] + dates[100:200]
    given = {
        "a": [(d, None if i % 50 == 0 else round(rng.gauss(50, 9), 1)) for i, d in enumerate(days)],
        "b": [(d, float(i % 7)) for i, d in enumerate(dates[:400])],
    }
    obs = spark.createDataFrame(
        [(d, s, v) for s, r in given.items() for d, v in r],
        "date string, station string, value double",
    )
    found = fl.climate_trend(
        obs, window=window, min_rows=min_rows, block_rows=block_rows
    ).toPandas()
    for s, r in given.items():
        want = climate(pd.DataFrame(r, columns=["date", "value"]), window, min_rows)
        # null readings of a date sort first in Spark and last in pandas, but no
        # date has two readings of which one is null unless it is doubled
        got = found[found.station_id == s]
        assert len(got) == len(want)
        columns = ["date", "value", "seasonal_mean", "anomaly"]
        pd.testing.assert_frame_equal(
            got[columns].sort_values(["date", "value"]).reset_index(drop=True),
            want[columns].sort_values(["date", "value"]).reset_index(drop=True),
        )
    b = climate(pd.DataFrame(given["b"], columns=["date", "value"]), window, min_rows)
    got = found[found.station_id == "b"].sort_values("date").long_term_trend
    pd.testing.assert_series_equal(
        got.reset_index(drop=True), b.long_term_trend, check_exact=False, atol=1e-9
    )


def test_climate_trend_of_one_series_with_real_dates(spark):
    dates = pd.date_range("2000-01-01", periods=800)
    frame = spark.createDataFrame(
        [(d.date(), float(i % 11)) for i, d in enumerate(dates)], "date date, temperature double"
    )
    found = fl.climate_trend(frame, by=None, value="temperature", window=50, min_rows=25)
    got = found.orderBy("date").toPandas()
    want = climate(
        pd.DataFrame({"date": dates, "value": [float(i % 11) for i in range(800)]}), 50, 25
    )
    assert got.date.tolist() == [str(d.date()) for d in dates]
    for c in ("seasonal_mean", "anomaly", "long_term_trend"):
        pd.testing.assert_series_equal(got[c], want[c], atol=1e-9)


def test_climate_trend_defaults_need_half_a_window(spark):
    dates = pd.date_range("2000-01-01", periods=1900)
    frame = spark.createDataFrame(
        [(str(d.date()), "a", 1.0) for d in dates], "date string, station string, value double"
    )
    found = fl.climate_trend(frame).orderBy("date").collect()
    trend = [r.long_term_trend for r in found]
    # every row reaches 1826 of the 1900 rows only from the middle
    reach = [min(i, 1826) + 1 + min(1899 - i, 1825) for i in range(1900)]
    assert [t is not None for t in trend] == [n >= 1826 for n in reach]


def test_dates_that_do_not_exist_have_no_anomaly(spark):
    frame = spark.createDataFrame(
        [("2001-02-31", "a", 5.0), ("2001-02-28", "a", 7.0), (None, "a", 1.0)],
        "date string, station string, value double",
    )
    for limit in (100, 1):
        found = fl.climate_trend(frame, window=3, min_rows=1, block_rows=limit)
        by_date = {r.date: (r.day_of_year, r.anomaly) for r in found.collect()}
        assert by_date == {"2001-02-31": (None, None), "2001-02-28": (59, 0.0), "": (None, None)}


def test_nested_series(spark, small):
    given = [(f"20{i % 3}0-01-{i % 28 + 1:02d}", "TMAX", "a", float(i % 5)) for i in range(60)]
    given += [("2000-01-05", "TMAX", "a", 2.0)] * 30
    given += [("2000-01-01", "TMAX", CORVALLIS, None), ("2000-01-02", "TMAX", CORVALLIS, 3.0)]
    flat = fl.series(from_rows(spark, given), "TMAX", window=3)
    nested = nest_series(flat).orderBy("station_id", "span").collect()
    assert [r.span for r in nested if r.station_id == "a"] == ["200", "201", "202"]
    packed = [tuple(p) for r in nested if r.station_id == "a" for p in r.points]
    want = flat.where("station_id = 'a'").orderBy("date", "value", "avg")
    assert packed == rows(want, "date", "value", "avg", "lpf")
    (corvallis,) = [r for r in nested if r.station_id == CORVALLIS]
    assert (corvallis.station_name, corvallis.first_date) == ("Corvallis", "2000-01-01")
    (first, second) = corvallis.points
    assert str(first.value) == "nan" and second.value == 3.0


def test_nested_months_are_one_row(spark, small):
    nested = nest_series(fl.mean_temp_trend(small, "monthly"))
    points = {r.station_name: [p.date for p in r.points] for r in nested.collect()}
    assert points == {"Corvallis": ["2000-01"], "Eugene": ["2000-01", "2000-02"]}


def test_two_names_for_a_station_stop_the_job(spark, small):
    twice = spark.createDataFrame([("Z1", "one"), ("Z1", "two")], "id string, name string")
    with pytest.raises(Exception, match="two names"):
        fl.series(small, "TMAX", names=twice).union(fl.series(small, "PRCP", names=twice)).union(
            fl.series(small, "TMIN", names=twice)
        ).collect()
