"""Rolling means and the low-pass, whole and in blocks."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frostline import climate_trend, series
from frostline.operators.long_series import blocks_for, number_rows
from frostline.operators.overlays import with_period_overlays
from frostline.operators.rolling import window_reach
from frostline.sources.files import from_rows

NAN, INF = float("nan"), float("inf")


def day(i):
    return str((pd.Timestamp("2000-01-01") + pd.Timedelta(days=i)).date())


def make(spark, **stations):
    rows = [
        (day(i), "TMAX", s, v) for s, vs in stations.items() for i, v in enumerate(vs)
    ]
    return from_rows(spark, rows)


def collect(frame, column):
    rows = frame.orderBy("station_id", "date", "value").collect()
    found = {}
    for r in rows:
        found.setdefault(r.station_id, []).append(r[column])
    return found


def same(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is b
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b or abs(a - b) <= tolerance


def assert_same(left, right, tolerance=1e-9):
    assert len(left) == len(right)
    assert all(same(a, b, tolerance) for a, b in zip(left, right)), list(zip(left, right))


def filtered(values, span):
    """The low-pass by plain recursion, skipping nulls."""
    weight = 2.0 / (span + 1.0)

    def one_pass(xs):
        state, out = None, []
        for x in xs:
            if x is None:
                out.append(None)
                continue
            state = x if state is None else (1 - weight) * state + weight * x
            out.append(state)
        return out

    return one_pass(one_pass(values)[::-1])[::-1]


def noise(n, seed=1):
    rng = random.Random(seed)
    return [round(60 + 30 * math.sin(i / 58) + rng.uniform(-9, 9), 1) for i in range(n)]


def test_no_overlay_without_a_width_above_one(spark):
    obs = make(spark, a=[1.0, 2.0, 3.0])
    for width in (None, 0, 1, -5):
        rows = series(obs, "TMAX", window=width, low_pass=width).collect()
        assert [(r.avg, r.lpf) for r in rows] == [(None, None)] * 3


def test_low_pass_is_linear(spark):
    one, two = noise(60, 2), noise(60, 3)
    mixed = [2.5 * x - y for x, y in zip(one, two)]
    found = collect(series(make(spark, a=one, b=two, c=mixed), "TMAX", low_pass=7), "lpf")
    assert_same(found["c"], [2.5 * x - y for x, y in zip(found["a"], found["b"])])


def test_low_pass_of_one_reading_in_closed_form(spark):
    # far from the ends, both passes together weigh a reading with a/(2-a) r^|distance|
    span, n, at = 4, 401, 200
    weight = 2 / (span + 1)
    lpf = collect(series(make(spark, a=[float(i == at) for i in range(n)]), "TMAX", low_pass=span), "lpf")["a"]
    want = [weight / (2 - weight) * (1 - weight) ** abs(i - at) for i in range(n)]
    assert_same(lpf[100:301], want[100:301], 1e-12)


@pytest.mark.parametrize("span", [2, 30])
def test_low_pass_forgets_nothing_too_early(spark, span):
    values = [0.0] * 400
    values[0] = 1e15
    lpf = collect(series(make(spark, a=values), "TMAX", low_pass=span, block_rows=50), "lpf")["a"]
    for have, want in zip(lpf, filtered(values, span)):
        assert abs(have - want) <= 1e-9 * abs(want)


@pytest.mark.parametrize("span", [2, 3, 30, 365])
def test_low_pass_equals_the_recursion(spark, span):
    values = noise(9000)
    lpf = collect(series(make(spark, a=values), "TMAX", low_pass=span), "lpf")["a"]
    assert_same(lpf, filtered(values, span), 1e-9)


def test_low_pass_skips_nulls(spark):
    values = [1.0, None, 3.0, 2.0]
    lpf = collect(series(make(spark, a=values), "TMAX", low_pass=3), "lpf")["a"]
    assert_same(lpf, [1.5, None, 2.0, 2.0])


@pytest.mark.parametrize("values", [[None, 1.0, None, None, 5.0, None], [None, None], [None]])
def test_low_pass_with_nulls_at_the_ends(spark, values):
    for limit in (1_000, 2):
        obs = make(spark, a=values)
        lpf = collect(series(obs, "TMAX", low_pass=4, block_rows=limit), "lpf")
        by_value = sorted(zip(values, filtered(values, 4)), key=repr)
        assert len(lpf["a"]) == len(values)
        assert sorted(map(repr, lpf["a"])) == sorted(repr(y) for _, y in by_value)


@pytest.mark.parametrize("special", [[NAN], [INF], [-INF], [INF, -INF]])
@pytest.mark.parametrize("limit", [1_000, 20])
def test_low_pass_carries_what_is_not_finite(spark, special, limit):
    values = noise(50)
    for at, v in zip((20, 31), special):
        values[at] = v
    obs = make(spark, a=values, b=noise(50))
    found = collect(
        series(obs, "TMAX", low_pass=2, block_rows=limit), "lpf"
    )
    assert_same(found["a"], filtered(values, 2))
    assert_same(found["b"], filtered(noise(50), 2))


def rolled(values, window, min_rows=1):
    before, after = window // 2, (window + 1) // 2 - 1
    out = []
    for i in range(len(values)):
        frame = [v for v in values[max(0, i - before) : i + after + 1] if v is not None]
        out.append(sum(frame) / len(frame) if len(frame) >= min_rows else None)
    return out


@pytest.mark.parametrize("window", [2, 3, 4, 30, 31, 150, 151, 400])
def test_rolling_mean_is_centred_on_rows(spark, window):
    values = noise(300)
    values[7] = values[150] = values[299] = None
    avg = collect(series(make(spark, a=values, b=noise(3)), "TMAX", window=window), "avg")
    assert_same(avg["a"], rolled(values, window))
    assert_same(avg["b"], rolled(noise(3), window))


@pytest.mark.parametrize("window", [4, 150])
@pytest.mark.parametrize("limit", [1_000, 20])
def test_rolling_mean_with_values_that_are_not_finite(spark, window, limit):
    values = noise(700)
    values[5], values[300], values[301], values[690] = INF, NAN, INF, -INF
    values[620] = INF
    obs = make(spark, a=values)
    avg = collect(series(obs, "TMAX", window=window, block_rows=limit), "avg")
    assert_same(avg["a"], rolled(values, window))


@pytest.mark.parametrize("window", [2, 50, 51, 365, 3652])
def test_a_large_reading_stays_within_its_windows(spark, window):
    values = [1e15, *noise(4200)[1:]]
    avg = collect(series(make(spark, a=values), "TMAX", window=window, block_rows=900), "avg")["a"]
    before, after = window_reach(window)
    for i in range(0, len(values), 61):
        frame = values[max(0, i - before) : i + after + 1]
        want = math.fsum(frame) / len(frame)
        assert abs(avg[i] - want) <= 1e-12 * abs(want)


def test_windows_have_a_limit():
    with pytest.raises(ValueError):
        window_reach(2**31)


def test_both_overlays_smooth_the_raw_values(spark):
    values = noise(200)
    both = series(make(spark, a=values), "TMAX", window=5, low_pass=7)
    assert_same(collect(both, "avg")["a"], rolled(values, 5))
    assert_same(collect(both, "lpf")["a"], filtered(values, 7))


@pytest.mark.parametrize("window, span", [(5, None), (None, 3), (150, 3), (6, 12)])
@pytest.mark.parametrize("block_rows", [70, 1000])
def test_blocks_give_what_whole_series_give(spark, window, span, block_rows):
    # one station with many copies of readings and many readings per day, one
    # with nulls, one short one
    rng = random.Random(7)
    rows = [("2000-01-05", "TMAX", "hot", 70.0)] * 900
    rows += [(day(rng.randrange(40)), "TMAX", "hot", rng.uniform(-5, 5)) for _ in range(800)]
    rows += [(day(i // 3), "TMAX", "gaps", None if i % 4 == 0 else float(i % 50)) for i in range(500)]
    rows += [(day(3), "TMAX", "gaps", None)] * 200
    rows += [(day(i), "TMAX", "short", float(i)) for i in range(30)]
    obs = from_rows(spark, rows).repartition(5)
    whole = series(obs, "TMAX", window=window, low_pass=span)
    parts = series(obs, "TMAX", window=window, low_pass=span, block_rows=block_rows)
    key = ["station_id", "station_name", "date", "value"]

    def listed(frame):
        rounded = frame.select(
            *key, F.round("avg", 7).alias("avg"), F.round("lpf", 7).alias("lpf")
        )
        return sorted(map(repr, rounded.collect()))

    assert listed(parts) == listed(whole)
    assert len(listed(parts)) == len(rows)


@pytest.mark.parametrize("span", [30, 1_000_000])
def test_low_pass_carries_over_blocks_of_any_span(spark, span):
    values = noise(3000)
    values[40:43], values[1200:1420] = [None] * 3, [None] * 220  # a few, and two whole blocks
    lpf = collect(series(make(spark, a=values, b=noise(7)), "TMAX", low_pass=span, block_rows=100), "lpf")
    assert_same(lpf["a"], filtered(values, span))
    assert_same(lpf["b"], filtered(noise(7), span))


@pytest.mark.parametrize("window", [101, 250, 999, 100_000])
def test_windows_wider_than_a_block(spark, window):
    values = noise(1203)
    values[3:5], values[700:820] = [None] * 2, [None] * 120
    obs = make(spark, a=values, b=noise(3), c=noise(250))
    both = series(obs, "TMAX", window=window, low_pass=9, block_rows=100)
    avg, lpf = collect(both, "avg"), collect(both, "lpf")
    for name, have in (("a", values), ("b", noise(3)), ("c", noise(250))):
        assert_same(avg[name], rolled(have, window))
        assert_same(lpf[name], filtered(have, 9))


def test_trend_with_a_window_wider_than_a_block(spark):
    obs = make(spark, a=noise(1500))
    parts, whole = (
        climate_trend(obs, window=365, min_rows=300, block_rows=n).orderBy("date").collect() for n in (40, 100_000)
    )
    assert_same([r.long_term_trend for r in parts], [r.long_term_trend for r in whole])


def test_a_large_reading_stays_within_wide_windows(spark):
    values = [1e15, *noise(2000)[1:]]
    avg = collect(series(make(spark, a=values), "TMAX", window=365, block_rows=90), "avg")["a"]
    assert_same(avg[400:], rolled(values, 365)[400:])


@pytest.mark.parametrize("window", [None, 101, 10_000_000])
def test_blocks_do_not_grow_with_wide_windows(spark, window):
    obs = make(spark, a=noise(2000))
    numbered = number_rows(obs, "station", "date", "value")
    blocks = blocks_for(numbered, "station", "value", window or 1, 100)
    assert blocks.groupBy("_block").count().agg({"count": "max"}).first()[0] == 100


def test_months_are_smoothed_in_one_shuffle(spark):
    values = noise(48)
    rows = [(f"{2000 + i // 12}-{i % 12 + 1:02d}", "a", v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "date string, station_id string, value double")
    found = with_period_overlays(frame, "station_id", "date", "value", 12, 6)
    assert_same(collect(found, "avg")["a"], rolled(values, 12))
    assert_same(collect(found, "lpf")["a"], filtered(values, 6))
