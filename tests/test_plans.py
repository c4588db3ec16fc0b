"""What the physical plans must and must not contain."""

import re

import pytest

import frostline as fl
from frostline.operators.nesting import nest_series
from frostline.operators.polyfit import polynomial_coefficients
from frostline.plans.ingest import combine
from frostline.sources.files import read_observations
from registry.observations import observations
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "observations")
    combine(observations(spark, SF), path)
    return read_observations(spark, path)


def final_plan(frame):
    """The plan that was run, once adaptive execution has finished it."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def exchanges(plan):
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_single_task(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in ("combine_report", "trend_report"):  # a count over the whole table
        assert "Exchange SinglePartition" not in plan


@pytest.mark.parametrize(
    "make, shuffles",
    [
        (lambda o: fl.series(o, "TMAX"), 0),
        (lambda o: fl.mean_temp_trend(o, "monthly"), 2),
        (lambda o: fl.mean_temp_trend(o, "monthly", window=3, low_pass=3), 3),
        (lambda o: fl.water_year_totals(o), 1),
    ],
)
def test_shuffles(table, make, shuffles):
    assert exchanges(final_plan(make(table))) == ["hashpartitioning"] * shuffles


@pytest.mark.parametrize(
    "make",
    [
        lambda o: fl.series(o, "TMAX", window=30),
        lambda o: fl.series(o, "TMAX", window=365, low_pass=30),
        lambda o: fl.climate_trend(o.where("datatype = 'TMAX'")),
        lambda o: fl.climate_trend(o.where("datatype = 'TMAX'"), by=None),
        lambda o: nest_series(fl.series(o, "TMAX", window=30)),
    ],
)
def test_no_window_holds_the_rows_of_a_station(table, make):
    plan = final_plan(make(table))
    assert "SinglePartition" not in plan
    windows = re.findall(r"Window \[(.*)\], \[(.*?)\](?:, \[|\n|$)", plan)
    by_station = [what for what, by in windows if re.fullmatch(r"station_id#\d+", by)]
    assert all("_n" in what or "_m" in what for what in by_station)  # counts of days only


def test_fits_combine_before_their_shuffle(table):
    points = table.selectExpr("station", "cast(substring(date, 1, 4) AS double) AS x", "value")
    plan = final_plan(polynomial_coefficients(points, "station", "x", "value", 2))
    assert "partial_sum" in plan and plan.count("FileScan") == 1
    # the one window lies above the sums: it sees stretches of x, never points
    windows, sums = [m.start() for m in re.finditer(r"Window \[", plan)], plan.rindex("partial_sum")
    assert len(windows) == 1 and windows[0] < sums


def test_scans_read_only_what_they_need(table):
    plan = final_plan(fl.series(table, "TMAX", "GHCND:USC00351862"))
    assert "PartitionFilters: [isnotnull(datatype" in plan
    assert "EqualTo(station,GHCND:USC00351862)" in plan
    plan = final_plan(fl.hot_days_per_year(table, 85.0))
    assert "GreaterThan(value,85.0)" in plan
    plan = final_plan(fl.stations(table))
    assert "ReadSchema: struct<station:string>" in plan


def test_nested_rows_hold_a_span_of_the_calendar(table):
    rows = nest_series(fl.series(table, "TMAX"), 4).collect()
    assert len({(r.station_id, r.span) for r in rows}) == len(rows)
    assert all(p.date[:4] == r.span and r.first_date == r.points[0].date for r in rows for p in r.points)
