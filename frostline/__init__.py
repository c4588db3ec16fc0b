"""Daily station records on Spark: ingest, smoothing, trends and seasons."""

from frostline.operators.nesting import nest_days_and_fit, nest_series
from frostline.operators.pairing import paired_days
from frostline.operators.polyfit import polynomial_coefficients, with_polynomial_fit
from frostline.plans.ingest import (
    LoadReport,
    combine,
    combine_csv,
    missing_years,
    save_trend,
    unfinished_pages,
)
from frostline.plans.queries import (
    climate_trend,
    datatypes,
    datatypes_of_table,
    growing_season,
    hot_days_per_year,
    in_display_order,
    mean_temp_trend,
    series,
    stations,
    stations_of_table,
    water_year_totals,
)
from frostline.schema import OBSERVATION, PAGE, STATION_NAMES
from frostline.sources.files import (
    from_rows,
    read_csv,
    read_observations,
    read_trend,
    replace_observations,
    write_csv,
    write_observations,
)
from frostline.sources.pages import page_index, page_observations, read_pages

__all__ = [
    "LoadReport",
    "OBSERVATION",
    "PAGE",
    "STATION_NAMES",
    "climate_trend",
    "combine",
    "combine_csv",
    "datatypes",
    "datatypes_of_table",
    "from_rows",
    "growing_season",
    "hot_days_per_year",
    "in_display_order",
    "mean_temp_trend",
    "missing_years",
    "nest_days_and_fit",
    "nest_series",
    "page_index",
    "page_observations",
    "paired_days",
    "polynomial_coefficients",
    "read_csv",
    "read_observations",
    "read_pages",
    "read_trend",
    "replace_observations",
    "save_trend",
    "series",
    "stations",
    "stations_of_table",
    "unfinished_pages",
    "water_year_totals",
    "with_polynomial_fit",
    "write_csv",
    "write_observations",
]
