"""Smoothed lines drawn over a series."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.operators.filters import wants
from frostline.operators.long_series import (
    BLOCK_ROWS,
    blocks_for,
    home_rows,
    number_rows,
)
from frostline.operators.lowpass import carried_between_blocks, low_pass
from frostline.operators.rolling import rolling_mean, wide_rolling_mean

_HELPERS = ("_n", "_pos", "_index", "_length", "_special")


def with_overlays(
    rows: DataFrame,
    by: str,
    date: str,
    value: str,
    window: int | None = None,
    span: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add `avg`, a centred rolling mean, and `lpf`, a low-pass, per series.

    Both smooth `value` itself, in (date, value) order, and are null when not asked for.
    Series of any length are smoothed block by block. Neither `by` nor `date` may be null.
    """
    rows = rows.select(by, date, value)
    if not wants(window) and not wants(span):
        none = F.lit(None).cast("double")
        return rows.withColumns({"avg": none, "lpf": none})
    return _smooth_blocks(rows, by, date, value, window, span, block_rows)


def with_period_overlays(
    rows: DataFrame,
    by: str,
    date: str,
    value: str,
    window: int | None = None,
    span: int | None = None,
) -> DataFrame:
    """As with_overlays, for rows grouped by (series, month or year): the calendar bounds
    such a series, so its windows gather it, and one shuffle serves all of them."""
    rows = rows.select(by, date, value)
    if not wants(window) and not wants(span):
        none = F.lit(None).cast("double")
        return rows.withColumns({"avg": none, "lpf": none})
    so_far = f"ORDER BY {date}, {value} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    not_finite = f"isnan({value}) OR abs({value}) = double('Infinity')"
    rows = rows.selectExpr(
        "*",
        f"count(1) OVER (PARTITION BY {by} {so_far}) - 1 AS _pos",
        f"count({value}) OVER (PARTITION BY {by} {so_far}) - 1 AS _index",
        f"count({value}) OVER (PARTITION BY {by}) AS _length",
        f"sum(CASE WHEN {not_finite} THEN {value} END) OVER (PARTITION BY {by}) AS _special",
    )
    rows = _rolling(rows, value, window, [by])
    if wants(span):
        rows = low_pass(rows, value, span, [by], "_index", "_length", "_special", "lpf", "_pos")
    else:
        rows = rows.withColumn("lpf", F.lit(None).cast("double"))
    return rows.drop(*_HELPERS)


def _smooth_blocks(rows, by, date, value, window, span, block_rows) -> DataFrame:
    """Both overlays over one layout of blocks, with margins if the window needs any."""
    none = F.lit(None).cast("double")
    wide = wants(window) and window > block_rows
    numbered = number_rows(rows, by, date, value)
    blocks = blocks_for(numbered, by, value, window if wants(window) else 1, block_rows)
    blocks = blocks.drop("_n") if wide else blocks.drop("_n", "_rows")
    rows = home_rows(blocks if wide else _rolling(blocks, value, window, [by, "_block"]))
    if wants(span):
        carried = carried_between_blocks(home_rows(blocks), by, value, span, "_index", "_length")
        enters, bounds = ("_in", "_back"), ("_first", "_next")
        rows = rows.join(carried, [by, "_block"])
        rows = low_pass(
            rows, value, span, [by, "_block"], "_index", "_length", "_special", "lpf", "_pos", enters, bounds
        )
    else:
        rows = rows.withColumn("lpf", none)
    if wide:
        rows = wide_rolling_mean(rows, by, value, window, block_rows, "avg")
    return rows.select(by, date, value, "avg", "lpf")


def _rolling(rows, value, window, within) -> DataFrame:
    if not wants(window):
        return rows.withColumn("avg", F.lit(None).cast("double"))
    return rolling_mean(rows, value, window, within, "_pos", "avg")
