"""DuckDB statements that compute the same results another way."""

from registry.observations import with_observations, with_readings
from registry.queries import CORVALLIS, OFF_TIES, PAGE_ROWS

NAME = """CASE station
  WHEN 'GHCND:USC00351862' THEN 'Corvallis'
  WHEN 'GHCND:USW00024221' THEN 'Eugene'
  WHEN 'GHCND:USW00024232' THEN 'Salem'
  ELSE station END"""

KEYS = f"station AS station_id, {NAME} AS station_name"

MEANS = """SELECT a.station, substr(a.date, 1, {n}) AS date,
    avg((a.value + b.value) / 2.0) AS value
  FROM {table} a JOIN {table} b
    ON a.station = b.station AND a.date = b.date
  WHERE a.datatype = 'TMAX' AND b.datatype = 'TMIN'
  GROUP BY 1, 2"""

HOT = """SELECT station, substr(date, 1, 4) AS date,
    CAST(count(value) AS DOUBLE) AS value
  FROM {table} WHERE datatype = 'TMAX' AND value > 85.0 GROUP BY 1, 2"""

SEASONS = """SELECT station, CAST(y AS VARCHAR) AS date,
    CAST(fall - spring AS DOUBLE) AS value
  FROM (
    SELECT station, year(d) AS y,
      max(CASE WHEN month(d) BETWEEN 3 AND 6 THEN dayofyear(d) END) AS spring,
      min(CASE WHEN month(d) BETWEEN 7 AND 11 THEN dayofyear(d) END) AS fall
    FROM (SELECT station, CAST(date AS DATE) AS d FROM {table}
          WHERE datatype = 'TMIN' AND value <= 32.0)
    GROUP BY 1, 2)
  WHERE fall > spring"""


HOT_DAYS, FROSTS = HOT.format(table="observations"), SEASONS.format(table="observations")


def _raw(datatype: str, condition: str = "", table: str = "observations") -> str:
    return (
        f"SELECT station, date, value FROM {table} "
        f"WHERE datatype = '{datatype}' {condition}"
    )


def _series(
    rows: str, window: int | None = None, span: int | None = None, source_of=with_observations,
    off_ties: float = 0.0,
) -> str:
    """Long form of `rows` (station, date, value) with optional overlays."""
    avg = lpf = "CAST(NULL AS DOUBLE)"
    ctes = [f"base AS MATERIALIZED ({rows})"]
    source = "base"
    if window:
        avg = (
            "round(avg(value) OVER (PARTITION BY station ORDER BY date, value NULLS FIRST ROWS BETWEEN "
            f"{window // 2} PRECEDING AND {(window + 1) // 2 - 1} FOLLOWING) + {off_ties!r}, 6)"
        )
    if span:
        alpha = repr(2.0 / (span + 1.0))
        step = f"{alpha} * n.{{x}} + (1.0 - {alpha}) * p.y"
        ctes += [
            """numbered AS MATERIALIZED (SELECT station, date, value,
               row_number() OVER (PARTITION BY station ORDER BY date, value) AS i,
               row_number() OVER (PARTITION BY station ORDER BY date DESC, value DESC) AS j
               FROM base WHERE value IS NOT NULL)""",
            f"""forward AS (SELECT station, i, j, value AS y FROM numbered WHERE i = 1
               UNION ALL SELECT n.station, n.i, n.j, {step.format(x='value')}
               FROM forward p JOIN numbered n ON n.station = p.station AND n.i = p.i + 1)""",
            "forwards AS MATERIALIZED (SELECT * FROM forward)",
            f"""backward AS (SELECT station, i, j, y FROM forwards WHERE j = 1
               UNION ALL SELECT n.station, n.i, n.j, {step.format(x='y')}
               FROM backward p JOIN forwards n ON n.station = p.station AND n.j = p.j + 1)""",
        ]
        source = (
            "(SELECT station, date, value, b.y FROM numbered "
            "JOIN backward b USING (station, i) UNION ALL "
            "SELECT station, date, value, NULL FROM base WHERE value IS NULL)"
        )
        lpf = "round(y, 6)"
    return source_of(
        f", {', '.join(ctes)} SELECT {KEYS}, date, round(value, 6) AS value, "
        f"{avg} AS avg, {lpf} AS lpf FROM {source}"
    )


def _fit(points: str, fitted: str, degree: int, source_of=with_observations) -> str:
    """Fit by orthogonal polynomials, each made by window sums over the station.

    `fitted` is the condition on the points that take part.
    """
    by = "OVER (PARTITION BY station)"
    terms = ["avg(y) {by}", "t * (sum(y * t) {by}) / nullif(sum(t * t) {by}, 0)"]
    ctes = f""", days AS MATERIALIZED ({points}),
    p0 AS (SELECT *, CAST(date AS DOUBLE) AS x, value AS y FROM days WHERE {fitted}),
    p1 AS (SELECT *, x - avg(x) {by} AS t, count(*) {by} AS n FROM p0),
    p2 AS (SELECT *, t * t - avg(t * t) {by}
      - t * (sum(t * t * t) {by}) / nullif(sum(t * t) {by}, 0) AS u FROM p1)"""
    last = "p2"
    terms.append("u * (sum(y * u) {by}) / nullif(sum(u * u) {by}, 0)")
    if degree == 3:
        ctes += f""", p3 AS (SELECT *, t * t * t - avg(t * t * t) {by}
      - t * (sum(t * t * t * t) {by}) / nullif(sum(t * t) {by}, 0)
      - u * (sum(t * t * t * u) {by}) / nullif(sum(u * u) {by}, 0) AS w FROM p2)"""
        last = "p3"
        terms.append("w * (sum(y * w) {by}) / nullif(sum(w * w) {by}, 0)")
    value = " + ".join(terms).format(by=by)
    return source_of(
        f"""{ctes}, fits AS (SELECT station, date,
      CASE WHEN n > {degree} THEN {value} END AS fit FROM {last})
    SELECT {KEYS}, date, value, round(fit, 6) AS fit
    FROM days LEFT JOIN fits USING (station, date)"""
    )


def _days_and_fit(report: str) -> str:
    """Both lists of points of a report, with their places."""
    def points(part: str, value: str) -> str:
        return f"""SELECT station_id, station_name, '{part}' AS part,
          CAST(row_number() OVER (PARTITION BY station_id ORDER BY date) - 1 AS INT) AS place, date, {value} AS value
          FROM report WHERE {value} IS NOT NULL"""

    return f"WITH report AS MATERIALIZED ({report}) {points('days', 'value')} UNION ALL {points('fit', 'fit')}"


def _nested_hot_days() -> str:
    report = _fit(HOT_DAYS, "CAST(date AS INT) >= 1980", 2)
    decade = "PARTITION BY station_id, substr(date, 1, 3)"
    return f"""SELECT station_id, substr(date, 1, 3) AS span, min(date) OVER ({decade}) AS first_date,
      CAST(row_number() OVER ({decade} ORDER BY date) - 1 AS INT) AS place, date, value, fit
      FROM ({report})"""


ORACLES: dict[str, str] = {
    "observations": with_observations("SELECT * FROM observations"),
    "stations": with_observations(
        f"SELECT DISTINCT station AS id, {NAME} AS name FROM observations"
    ),
    "datatypes": with_observations("SELECT DISTINCT datatype FROM observations"),
    "series_tmax": _series(_raw("TMAX")),
    "series_one_station": _series(_raw("TMIN", f"AND station = '{CORVALLIS}'")),
    "series_rolling_30": _series(_raw("TMAX"), window=30),
    "series_rolling_31": _series(_raw("TMAX"), window=31),
    "series_rolling_365": _series(_raw("PRCP"), window=365),
    "series_lowpass_30": _series(_raw("TMAX"), span=30),
    "series_both_overlays": _series(_raw("TMAX"), window=31, span=90),
    "series_blocks": _series(_raw("TMAX"), window=31, span=3),
    "series_lowpass_100000": _series(_raw("TMAX"), span=100_000),
    "series_rolling_wide": _series(_raw("TMAX"), window=801, span=12, off_ties=OFF_TIES),
    "tmax_tmin_days": with_observations(
        """SELECT a.station, a.date, a.value AS tmax, b.value AS tmin,
             (a.value + b.value) / 2.0 AS mean_temp, CAST(1 AS BIGINT) AS copies
           FROM observations a JOIN observations b
             ON a.station = b.station AND a.date = b.date
           WHERE a.datatype = 'TMAX' AND b.datatype = 'TMIN'"""
    ),
    "mean_temp_monthly": _series(MEANS.format(n=7, table="observations")),
    "mean_temp_yearly": _series(MEANS.format(n=4, table="observations")),
    "mean_temp_one_station": _series(
        f"SELECT * FROM ({MEANS.format(n=7, table="observations")}) WHERE station = '{CORVALLIS}'"
    ),
    "mean_temp_monthly_smoothed": _series(MEANS.format(n=7, table="observations"), window=12, span=6),
    "hot_days_85": with_observations(f"SELECT {KEYS}, date, value FROM ({HOT_DAYS})"),
    "hot_days_fit_85": _fit(HOT_DAYS, "CAST(date AS INT) >= 1980", 2),
    "hot_days_nested": _nested_hot_days(),
    "hot_days_and_fit": _days_and_fit(_fit(HOT_DAYS, "CAST(date AS INT) >= 1980", 2)),
    "growing_season_and_fit": _days_and_fit(_fit(FROSTS, "true", 3)),
    "growing_season": with_observations(
        f"SELECT {KEYS}, date, value FROM ({FROSTS})"
    ),
    "growing_season_fit": _fit(FROSTS, "true", 3),
    "season_line": with_observations(
        f"""SELECT station AS station_id, round(avg(x), 6) AS center,
             round(avg(value), 6) AS c0, round(regr_slope(value, x), 6) AS c1
           FROM (SELECT *, CAST(date AS DOUBLE) AS x FROM ({FROSTS})) GROUP BY 1"""
    ),
    "climate_trend_365": with_observations(
        """, highs AS (SELECT station, date, value,
             dayofyear(CAST(date AS DATE)) AS day_of_year
             FROM observations WHERE datatype = 'TMAX'),
           seasonal AS (SELECT station, day_of_year, avg(value) AS seasonal_mean
             FROM highs GROUP BY 1, 2),
           anomalies AS (SELECT *, value - seasonal_mean AS anomaly
             FROM highs LEFT JOIN seasonal USING (station, day_of_year))
           SELECT station AS station_id, date, value,
             CAST(day_of_year AS INT) AS day_of_year,
             round(seasonal_mean + 1.7e-8, 6) AS seasonal_mean, round(anomaly + 1.7e-8, 6) AS anomaly,
             round(CASE WHEN count(anomaly) OVER w >= 182
                   THEN avg(anomaly) OVER w END + 1.7e-8, 6) AS long_term_trend
           FROM anomalies WINDOW w AS (PARTITION BY station ORDER BY date
             ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)"""
    ),
    "climate_trend_all": with_observations(
        """, highs AS (SELECT date, value, dayofyear(CAST(date AS DATE)) AS day_of_year
             FROM observations WHERE datatype = 'TMAX'),
           seasonal AS (SELECT day_of_year, avg(value) AS seasonal_mean FROM highs GROUP BY 1),
           anomalies AS (SELECT *, value - seasonal_mean AS anomaly
             FROM highs LEFT JOIN seasonal USING (day_of_year))
           SELECT '' AS station_id, date, value, CAST(day_of_year AS INT) AS day_of_year,
             round(seasonal_mean + 1.7e-8, 6) AS seasonal_mean, round(anomaly + 1.7e-8, 6) AS anomaly,
             round(CASE WHEN count(anomaly) OVER w >= 1826
                   THEN avg(anomaly) OVER w END + 1.7e-8, 6) AS long_term_trend
           FROM anomalies WINDOW w AS (ORDER BY date, value
             ROWS BETWEEN 1826 PRECEDING AND 1825 FOLLOWING)"""
    ),
    "water_year_precip": with_observations(
        f"""SELECT {KEYS}, CAST(year(d) + CAST(month(d) >= 10 AS INT) AS VARCHAR) AS date,
             sum(value) AS value
           FROM (SELECT *, CAST(date AS DATE) AS d FROM observations
                 WHERE datatype = 'PRCP')
           GROUP BY 1, 2, 3"""
    ),
    "calendar_days": with_observations(
        """SELECT date, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month,
             CAST(dayofyear(d) AS INT) AS day_of_year,
             CAST(dayofyear(d) AS INT) AS ordinal_day,
             CAST(year(d) + CAST(month(d) >= 10 AS INT) AS INT) AS water_year,
             count(*) AS readings
           FROM (SELECT *, CAST(date AS DATE) AS d FROM observations)
           GROUP BY date, d"""
    ),
    "series_nested": with_observations(
        f""", smooth AS (SELECT *, avg(value) OVER (PARTITION BY station ORDER BY date
             ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS mean
             FROM observations WHERE datatype = 'TMAX')
           SELECT {KEYS}, substr(date, 1, 3) AS span,
             min(date) OVER (PARTITION BY station, substr(date, 1, 3)) AS first_date,
             CAST(row_number() OVER (PARTITION BY station, substr(date, 1, 3) ORDER BY date) - 1 AS INT) AS place,
             date, value, round(mean, 6) AS avg, CAST(NULL AS DOUBLE) AS lpf
           FROM smooth"""
    ),
    "combine_csv_roundtrip": with_observations(
        "SELECT date, datatype, station, value FROM observations"
    ),
    "combine_report": with_observations(
        """SELECT count(*) AS reported_rows,
             'datatype,date,station,value' AS columns, count(*) AS written_rows
           FROM observations"""
    ),
    "trend_report": with_observations(
        """SELECT count(*) AS reported_rows,
             'anomaly,date,day_of_year,long_term_trend,seasonal_mean,station_id,value' AS columns,
             count(*) AS written_rows, count(*) FILTER (n >= 182) AS smoothed_rows
           FROM (SELECT count(value) OVER (PARTITION BY station ORDER BY date
             ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) AS n
             FROM observations WHERE datatype = 'TMAX')"""
    ),
    "table_replaced": with_observations("SELECT date, datatype, station, value FROM observations"),
    "table_stations": with_observations(
        f"SELECT DISTINCT station AS id, {NAME} AS name FROM observations"
    ),
    "table_datatypes": with_observations("SELECT DISTINCT datatype FROM observations"),
    "ingest_pages": with_observations(
        "SELECT date, datatype, station, value FROM observations"
    ),
    "ingest_gaps": with_observations(
        """SELECT s.station, CAST(y.year AS INT) AS year
           FROM (SELECT DISTINCT station FROM observations) s,
             (SELECT unnest(range(1970, 1991)) AS year) y
           WHERE NOT EXISTS (SELECT 1 FROM observations o
             WHERE o.station = s.station AND CAST(substr(o.date, 1, 4) AS INT) = y.year)"""
    ),
    "ingest_unfinished": with_observations(
        f"""SELECT station, CAST(substr(date, 1, 4) AS INT) AS year,
             CAST(count(*) - {PAGE_ROWS} + 1 AS INT) AS "offset"
           FROM observations GROUP BY 1, 2 HAVING count(*) % {PAGE_ROWS} = 0"""
    ),
    "tmax_tmin_days_repeated": with_readings(
        """SELECT a.station, a.date, a.value AS tmax, b.value AS tmin,
             (a.value + b.value) / 2.0 AS mean_temp, count(*) AS copies
           FROM readings a JOIN readings b ON a.station = b.station AND a.date = b.date
           WHERE a.datatype = 'TMAX' AND b.datatype = 'TMIN'
           GROUP BY ALL"""
    ),
    "tmax_tmin_years_crowded": with_readings(
        """, years AS (SELECT station, substr(date, 1, 4) AS date, datatype, value, count(*) AS n
             FROM readings GROUP BY ALL)
           SELECT a.station, a.date, a.value AS tmax, b.value AS tmin,
             (a.value + b.value) / 2.0 AS mean_temp, a.n * b.n AS copies
           FROM years a JOIN years b ON a.station = b.station AND a.date = b.date
           WHERE a.datatype = 'TMAX' AND b.datatype = 'TMIN'"""
    ),
    "mean_temp_repeated": _series(
        MEANS.format(n=7, table="readings"), source_of=with_readings
    ),
    "series_rolling_repeated": _series(
        _raw("TMAX", table="readings"), window=51, source_of=with_readings
    ),
    "series_lowpass_nulls": _series(
        _raw("TMAX", table="readings"), span=30, source_of=with_readings
    ),
    "hot_days_no_fit": _fit(
        HOT.format(table="readings"), "CAST(date AS INT) >= 1980", 2, with_readings
    ),
    "growing_season_no_fit": _fit(SEASONS.format(table="readings"), "true", 3, with_readings),
    "growing_season_no_curve": _days_and_fit(_fit(SEASONS.format(table="readings"), "true", 3, with_readings)),
    # a null value is NaN in a point, which comes after all numbers of its date
    "series_nested_nulls": with_readings(
        f""", points AS (SELECT station, date, coalesce(value, CAST('NaN' AS DOUBLE)) AS value
             FROM readings WHERE datatype = 'TMAX')
           SELECT {KEYS}, substr(date, 1, 3) AS span,
             min(date) OVER (PARTITION BY station, substr(date, 1, 3)) AS first_date,
             CAST(row_number() OVER (PARTITION BY station, substr(date, 1, 3) ORDER BY date, value) - 1 AS INT) AS place,
             date, value, CAST(NULL AS DOUBLE) AS avg, CAST(NULL AS DOUBLE) AS lpf
           FROM points"""
    ),
}
ORACLES["climate_trend_wide"] = ORACLES["climate_trend_365"]
