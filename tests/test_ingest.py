import json
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import frostline as fl
from frostline.plans.ingest import combine, missing_years, unfinished_pages
from frostline.schema import OBSERVATION
from frostline.sources.files import (
    from_rows,
    read_csv,
    read_observations,
    write_csv,
    write_observations,
)
from frostline.sources.pages import page_index, page_observations, read_pages
from frostline.sources.shared import remove, shared_path

ROWS = [
    ("2000-01-01", "TMAX", "a", 61.0),
    ("2000-01-01", "TMAX", "a", 61.0),
    ("2000-01-02", "TMIN", "b", -0.5),
    ("2000-01-02", "007", "b", None),
    ("2000-01-03", 'quo"te, d', " b ", 1e-7),
]


def listed(frame):
    return sorted(map(repr, map(tuple, frame.select(*OBSERVATION.fieldNames()).collect())))


def test_csv_files_are_stacked_with_copies(spark, tmp_path):
    (tmp_path / "one.csv").write_text(
        "date,datatype,station,value\n2000-01-01,TMAX,a,61\n2000-01-01,TMAX,a,61\n"
    )
    (tmp_path / "two.csv").write_text("date,datatype,station,value\n2000-01-01,TMAX,a,61\n")
    (tmp_path / "notes.txt").write_text("not,a,csv\n")
    found = read_csv(spark, str(tmp_path))
    assert found.schema == OBSERVATION
    # a whole number is a double, and a date stays text
    assert listed(found) == [repr(("2000-01-01", "TMAX", "a", 61.0))] * 3


def test_no_csv_files_is_not_an_error(spark, tmp_path):
    assert read_csv(spark, str(tmp_path)) is None
    assert fl.combine_csv(spark, str(tmp_path), str(tmp_path / "out")) is None
    assert not (tmp_path / "out").exists()


def test_a_header_without_rows_makes_an_empty_table(spark, tmp_path):
    (tmp_path / "one.csv").write_text("date,datatype,station,value\n")
    report = fl.combine_csv(spark, str(tmp_path), str(tmp_path / "out"))
    assert report.rows == 0
    found = read_observations(spark, report.path)
    assert found.count() == 0 and fl.datatypes(found).count() == 0


def test_bad_values_and_headers_stop_the_read(spark, tmp_path):
    (tmp_path / "one.csv").write_text("date,datatype,station,value\n2000-01-01,TMAX,a,x\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_csv(spark, str(tmp_path)).collect()
    other = tmp_path / "other"
    other.mkdir()
    (other / "one.csv").write_text("datatype,date,station,value\nTMAX,2000-01-01,a,1\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(other)).collect()


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    assert write_csv(from_rows(spark, ROWS), path)
    assert listed(read_csv(spark, path)) == listed(from_rows(spark, ROWS))
    head = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0]
    assert head == "date,datatype,station,value"


def test_csv_without_rows_is_not_written(spark, tmp_path):
    assert not write_csv(from_rows(spark, []), str(tmp_path / "csv"))
    assert not (tmp_path / "csv").exists()


def test_combined_table_replaces_the_old_one(spark, tmp_path):
    path = str(tmp_path / "all")
    assert write_observations(from_rows(spark, ROWS[:1]), path) == 1
    report = combine(from_rows(spark, ROWS), path)
    assert (report.rows, report.columns) == (5, OBSERVATION.fieldNames())
    found = read_observations(spark, path)
    assert found.columns and listed(found) == listed(from_rows(spark, ROWS))
    # digits stay text although they name a folder
    assert found.where("datatype = '007'").count() == 1


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_files_hold_few_stations_and_hot_datatypes_many_tasks(spark, tmp_path, adaptive):
    path = str(tmp_path / "all")
    rows = spark.range(400_000).select(
        F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 40_000).cast("int"))
        .cast("string").alias("date"),
        F.when(F.col("id") % 10 == 0, "TMIN").otherwise("TMAX").alias("datatype"),
        F.concat(F.lit("s"), F.floor(F.col("id") / 40_000)).alias("station"),
        F.rand(1).alias("value"),
    )
    keys = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        write_observations(rows.repartition(8), path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = spark.read.parquet(path).where("datatype = 'TMAX'").groupBy(F.input_file_name()).agg(
        F.min("station").alias("low"), F.max("station").alias("high")
    ).orderBy("low", "high").collect()
    assert len(files) > 4
    assert all(a.high <= b.low for a, b in zip(files, files[1:]))
    assert read_observations(spark, path).count() == 400_000


@pytest.mark.parametrize("name", ["_b.csv", ".c.csv"])
def test_files_that_spark_passes_over_are_named(spark, tmp_path, name):
    (tmp_path / "a.csv").write_text("date,datatype,station,value\n2000-01-01,TMAX,a,1\n")
    (tmp_path / name).write_text("date,datatype,station,value\n2000-01-02,TMAX,a,2\n")
    with pytest.raises(ValueError, match=name):
        fl.combine_csv(spark, str(tmp_path), str(tmp_path / "all"))


def test_line_breaks_need_to_be_asked_for(spark, tmp_path):
    rows = from_rows(spark, [("2000-01-01", "TMAX", "two\nlines", 1.0), ("2000-01-02", "TMAX", 'a "b"', 2.0)])
    with pytest.raises(Exception, match="line break"):
        write_csv(rows, str(tmp_path / "one"))
    assert write_csv(rows, str(tmp_path / "two"), multi_line=True)
    assert listed(read_csv(spark, str(tmp_path / "two"), multi_line=True)) == listed(rows)


def test_an_empty_datatype_stops_the_write(spark, tmp_path):
    with pytest.raises(Exception, match="empty datatype"):
        write_observations(from_rows(spark, [("2000-01-01", "", "a", 1.0)]), str(tmp_path / "all"))
    path = str(tmp_path / "null")
    write_observations(from_rows(spark, [("2000-01-01", None, "a", 1.0)]), path)
    assert [r.datatype for r in read_observations(spark, path).collect()] == [None]


def test_one_file_table_is_read_too(spark, tmp_path):
    path = str(tmp_path / "one")
    from_rows(spark, ROWS).coalesce(1).write.parquet(path)
    assert listed(read_observations(spark, path)) == listed(from_rows(spark, ROWS))


def page(offset, n, year=1998, station="a"):
    results = [
        {"date": f"{year}-01-{i % 28 + 1:02d}T00:00:00", "datatype": "TMAX",
         "station": station, "value": 50 + i, "attributes": ",,W,"}
        for i in range(n)
    ]
    return {"station": station, "year": year, "offset": offset, "results": results}


def test_pages(spark, tmp_path):
    pages = [page(1, 1000), page(1001, 1), page(1, 0, 1999), {"station": "a", "year": 2000, "offset": 1}]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, pages)))
    landed = read_pages(spark, str(tmp_path))
    found = page_observations(landed)
    assert found.schema == OBSERVATION
    assert found.count() == 1001
    assert found.where("length(date) <> 10").count() == 0
    index = sorted(tuple(r) for r in page_index(landed).collect())
    assert index == [("a", 1998, 1, 1000), ("a", 1998, 1001, 1), ("a", 1999, 1, 0), ("a", 2000, 1, 0)]
    assert unfinished_pages(page_index(landed)).count() == 0


def test_a_page_may_fill_its_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(page(1, 2), indent=1))
    assert page_observations(read_pages(spark, str(tmp_path), one_per_file=True)).count() == 2


def test_full_pages_need_a_successor(spark):
    pages = spark.createDataFrame(
        [("a", 1998, 1, 1000), ("a", 1998, 1001, 1000), ("a", 1999, 1, 1000),
         ("a", 1999, 1001, 3), ("b", 1998, 1, 999), ("b", 1998, 2001, 5)],
        "station string, year int, offset int, rows int",
    )
    assert [tuple(r) for r in unfinished_pages(pages).collect()] == [("a", 1998, 1001)]


def test_missing_years(spark):
    obs = from_rows(
        spark,
        [("2000-05-01", "TMAX", "a", 1.0), ("2002-05-01", "TMIN", "a", 1.0), ("x", "TMIN", "b", 1.0)],
    )
    first = spark.createDataFrame(
        [("a", 1999), ("b", 2003), ("c", 2010)], "station string, first_year int"
    )
    found = sorted(tuple(r) for r in missing_years(obs, first, 2003).collect())
    assert found == [("a", 1999), ("a", 2001), ("a", 2003), ("b", 2003)]


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_path(spark, "t").startswith(f"{folder}/t-")
    assert shared_path(spark, "t") != shared_path(spark, "t")


def test_without_a_shared_folder_only_a_local_session_goes_on(tmp_path):
    def session(master):
        conf = SimpleNamespace(get=lambda key, default: default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_path(session("local[4]"), "t").startswith(tempfile.gettempdir())
    assert shared_path(session("yarn"), "t", "/shared").startswith("/shared/t-")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_path(session(master), "t")


def test_tables_can_be_removed(spark, tmp_path):
    path = shared_path(spark, "gone", str(tmp_path))
    spark.range(3).write.parquet(path)
    remove(spark, path)
    assert list(tmp_path.iterdir()) == []


def test_a_lost_load_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "all")
    combine(from_rows(spark, ROWS[:1]), path)
    bad = from_rows(spark, [*ROWS, ("2000-01-01", "", "a", 1.0)])  # an empty datatype stops the write
    with pytest.raises(Exception, match="empty datatype"):
        combine(bad, path)
    old = read_observations(spark, path)
    assert [tuple(r) for r in old.select(*OBSERVATION.fieldNames()).collect()] == [ROWS[0]]
    assert combine(from_rows(spark, ROWS), path).rows == len(ROWS)
    assert read_observations(spark, path).count() == len(ROWS)
    assert old.count() == 1  # a plan made before the switch still reads the old version
    combine(from_rows(spark, ROWS[:2]), path)
    assert len(list((tmp_path / "all" / "_table").iterdir())) == 2  # the lost one is gone too
    assert read_observations(spark, path).count() == 2


def test_listings_from_the_load(spark, tmp_path):
    rows = [("2000-01-01", t, s, 1.0) for t, s in (("T/MAX %", "b"), ("PRCP", "a"), (None, "c"), ("PRCP", None))]
    path, plain = str(tmp_path / "all"), str(tmp_path / "plain")
    combine(from_rows(spark, rows), path)
    from_rows(spark, rows).write.parquet(plain)  # neither folders nor versions
    for at in (path, plain):
        assert [r.datatype for r in fl.datatypes_of_table(spark, at).collect()] == ["PRCP", "T/MAX %"]
        assert [tuple(r) for r in fl.stations_of_table(spark, at).collect()] == [(s, s) for s in "abc"]
    assert "Parquet" not in fl.datatypes_of_table(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_a_trend_is_saved_and_replaced(spark, tmp_path):
    trend = fl.climate_trend(from_rows(spark, [(f"2000-01-{d:02d}", "TMAX", "a", float(d)) for d in range(1, 31)]), window=5, min_rows=3)
    path = str(tmp_path / "trend")
    assert fl.save_trend(trend.limit(0), path).rows == 0
    report = fl.save_trend(trend, path)
    assert (report.rows, report.columns) == (30, trend.columns)
    assert sorted(fl.read_trend(spark, path).collect()) == sorted(trend.collect())
