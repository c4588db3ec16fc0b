import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline import growing_season, hot_days_per_year, nest_days_and_fit
from frostline.functions.values import polynomial
from frostline.operators.polyfit import (
    polynomial_coefficients,
    with_period_fit,
    with_polynomial_fit,
)
from frostline.operators.seasons import season_lengths
from frostline.sources.files import from_rows


def points(spark, **series):
    rows = [(s, float(x), float(y)) for s, ps in series.items() for x, y in ps]
    return spark.createDataFrame(rows, "s string, x double, y double")


def fitted(frame, degree):
    rows = with_polynomial_fit(frame, "s", "x", "y", degree, "fit").orderBy("s", "x")
    return [r.fit for r in rows.collect()]


def coefficients(frame, degree):
    rows = polynomial_coefficients(frame, "s", "x", "y", degree).collect()
    return {r.s: (r.center, [r[f"c{k}"] for k in range(degree + 1)]) for r in rows}


def test_parabola_is_reproduced(spark):
    f = lambda x: 5 - 2 * x + 0.5 * x * x
    frame = points(spark, a=[(x, f(x)) for x in range(1, 11)])
    assert np.allclose(fitted(frame, 2), [f(x) for x in range(1, 11)], atol=1e-9, rtol=0)
    center, c = coefficients(frame, 2)["a"]
    assert center == 5.5
    at = spark.range(1).select(
        polynomial([F.lit(v) for v in c], F.lit(7.0) - F.lit(center)).alias("v")
    )
    assert abs(at.first().v - f(7.0)) < 1e-9


def test_cubic_is_reproduced(spark):
    f = lambda x: x**3 - 2 * x * x + 0.5 * x + 3
    frame = points(spark, a=[(x, f(x)) for x in range(1, 21)])
    assert np.allclose(fitted(frame, 3), [f(x) for x in range(1, 21)], atol=1e-8, rtol=0)


def test_too_few_points_give_no_fit(spark):
    frame = points(spark, a=[(2000, 5), (2001, 6)])
    assert fitted(frame, 2) == [None, None]
    assert coefficients(frame, 2)["a"][1] == [None] * 3
    empty = frame.where("false")
    assert fitted(empty, 0) == [] and coefficients(empty, 0) == {}


def test_equal_x_gives_no_fit(spark):
    frame = points(spark, a=[(2000, y) for y in range(6)])
    for degree in (1, 2, 3):
        assert fitted(frame, degree) == [None] * 6
    assert fitted(frame, 0) == [2.5] * 6


@pytest.mark.parametrize("degree", [0, 1, 2, 3, 4])
def test_fit_equals_least_squares_per_series(spark, degree):
    rng = random.Random(degree)
    series = {
        s: [(y, rng.uniform(0, 90)) for y in range(start, start + n)]
        for s, start, n in (("a", 1893, 130), ("b", 1980, 40), ("c", 2000, 6))
    }
    frame = points(spark, **series)
    got = fitted(frame, degree)
    want = []
    for ps in series.values():
        x, y = np.array(ps).T
        t = x - x.mean()
        want += list(np.polyval(np.polyfit(t, y, degree), t))
    assert np.allclose(got, want, atol=1e-8, rtol=0)


def test_season_lengths(spark):
    frost = {
        "a": ["2000-04-15", "2000-10-01", "2000-11-05", "2000-01-10", "1999-05-01"],
        "b": ["2000-04-01", "2000-09-15"],
        "c": ["1901-01-01", "1901-12-12", "1915-02-15", "1915-12-29"],
        "d": ["1901-04-01", "1901-09-15"],
        # 31 June and 1 July are the same day of the year
        "e": ["2001-06-31", "2001-07-01"],
        "f": ["2001-06-30", "2001-07-01", "bad", None],
    }
    rows = [(s, d) for s, ds in frost.items() for d in ds] + [(None, "2000-04-01")]
    frame = spark.createDataFrame(rows, "station string, date string")
    found = {(r.station, r.year, r.days) for r in season_lengths(frame).collect()}
    assert found == {("a", 2000, 169), ("b", 2000, 167), ("d", 1901, 167), ("f", 2001, 1)}


def test_growing_season_takes_lows_at_or_below_freezing(spark):
    rows = []
    for i, year in enumerate(range(2000, 2004)):
        rows += [
            (f"{year}-04-{10 + i * i}", "TMIN", "s", 32.0),
            (f"{year}-05-01", "TMIN", "s", 32.1),
            (f"{year}-05-01", "TMAX", "s", 20.0),
            (f"{year}-05-01", "TMIN", "s", None),
            (f"{year}-05-01", "TMIN", "s", float("nan")),
            (f"{year}-10-01", "TMIN", "s", 30.0),
        ]
    rows += [("2000-04-01", "TMIN", "t", 30.0), ("2000-10-01", "TMIN", "t", 30.0)]
    found = growing_season(from_rows(spark, rows)).orderBy("station_id", "date").collect()
    assert [(r.station_id, r.date, r.value) for r in found] == [
        ("s", "2000", 174.0),
        ("s", "2001", 173.0),
        ("s", "2002", 170.0),
        ("s", "2003", 165.0),
        ("t", "2000", 183.0),
    ]
    assert np.allclose([r.fit for r in found[:4]], [174, 173, 170, 165])
    assert found[4].fit is None


def test_hot_days_are_strictly_above_and_fitted_from_1980(spark):
    def hot(year, n, value=91.0):
        return [(f"{year}-07-{d:02d}", "TMAX", "s", value) for d in range(1, n + 1)]

    rows = hot(1979, 9) + hot(1980, 1) + hot(1981, 4) + hot(1982, 9) + hot(1983, 5, 90.0)
    rows += [("1984-07-01", "TMAX", "s", None), ("1985-07-01", "TMIN", "s", 99.0)]
    rows += [("xx", "TMAX", "s", 99.0), ("1986-07-01", "TMAX", "s", float("nan"))]
    found = hot_days_per_year(from_rows(spark, rows), 90).orderBy("date").collect()
    # a year without a hot day is absent; NaN is above every number
    assert [(r.date, r.value) for r in found] == [
        ("1979", 9.0), ("1980", 1.0), ("1981", 4.0), ("1982", 9.0), ("1986", 1.0), ("xx", 1.0),
    ]
    assert found[0].fit is None and found[5].fit is None
    x = np.array([1980, 1981, 1982, 1986]) - 1982.25
    want = np.polyval(np.polyfit(x, [1, 4, 9, 1], 2), x)
    assert np.allclose([r.fit for r in found[1:5]], want)


def test_points_far_apart_share_their_moments(spark):
    f = lambda x: 0.25 * x * x - 3 * x + 1
    frame = points(spark, a=[(x, f(x)) for x in range(1500, 2100, 7)], b=[(x, 2.0) for x in (-5000, 0, 5000, 9)])
    assert np.allclose(fitted(frame, 2)[: len(range(1500, 2100, 7))], [f(x) for x in range(1500, 2100, 7)], rtol=1e-9)
    assert abs(coefficients(frame, 2)["a"][0] - np.mean(range(1500, 2100, 7))) < 1e-9


def test_windows_fit_as_the_join_does(spark):
    rng = random.Random(4)
    frame = points(spark, a=[(x, rng.random()) for x in range(1990, 2020)], b=[(1, 1), (2, 2)], c=[(2000, y) for y in range(6)])
    frame = frame.unionByName(spark.createDataFrame([("a", None, 3.0), ("d", None, 1.0)], frame.schema))
    key = lambda r: (r.s, r.x is None, r.x, r.y)
    for degree in (0, 1, 2, 3):
        left, right = (
            sorted(fit(frame, "s", "x", "y", degree, "fit").collect(), key=key) for fit in (with_polynomial_fit, with_period_fit)
        )
        for a, b in zip(left, right, strict=True):
            assert a[:3] == b[:3] and (a.fit is None) == (b.fit is None)
            assert a.fit is None or abs(a.fit - b.fit) < 1e-9


def test_days_and_fit_are_two_lists(spark):
    rows = [(f"{1978 + i}-07-0{d}", "TMAX", s, 90.0) for s in "ab" for i in range(6 if s == "a" else 3) for d in range(1, 2 + i)]
    found = {r.station_id: r for r in nest_days_and_fit(hot_days_per_year(from_rows(spark, rows), 85.0)).collect()}
    assert [(p.date, p.value) for p in found["a"].days] == [(str(1978 + i), i + 1.0) for i in range(6)]
    assert [p.date for p in found["a"].fit] == ["1980", "1981", "1982", "1983"]
    assert np.allclose([p.value for p in found["a"].fit], [3, 4, 5, 6])
    assert len(found["b"].days) == 3 and found["b"].fit == []
