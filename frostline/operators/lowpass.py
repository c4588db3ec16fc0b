"""Zero-phase exponential low-pass filter."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.values import ema_rows, ema_weight

# Decay over one stretch. Powers up to e^300 leave room for values up to 1e170.
STRETCH_DECAY = 300.0
# Beyond this decay a weight is no longer a double above zero.
VANISHED = 745.0


def _decaying_sum(
    rows: DataFrame, term: str, at: str, order: str, span: int, within: list[str], out: str
) -> DataFrame:
    """Add the sum of the terms so far, each times r^distance with r = 1 - 2 / (span + 1).

    `at` gives the places distances are counted between; it never falls along `order`. The
    sum is r^at times the running sum of term r^-at. Running sums restart every `stretch`
    places, which keeps the powers far from overflow; what comes in from the stretches before
    are their last sums, until their weight is no longer a double above zero.
    """
    log_keep = f"({math.log1p(-ema_weight(span))!r}D)"
    stretch = ema_rows(span, STRETCH_DECAY)
    carried = range(1, math.ceil(VANISHED / STRETCH_DECAY) + 1)
    group = ", ".join(within)
    in_order = f"PARTITION BY {group}, _stretch ORDER BY {order}"
    so_far = f"{in_order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    earlier = f"PARTITION BY {group} ORDER BY _stretch RANGE BETWEEN {{k}} PRECEDING AND {{k}} PRECEDING"
    carry = " + ".join(
        f"exp({log_keep} * (_step + {(k - 1) * stretch})) "
        f"* coalesce(sum(_leaves) OVER ({earlier.format(k=k)}), 0D)"
        for k in carried
    )
    return (
        rows.selectExpr("*", f"floor(({at}) / {stretch}) AS _stretch", f"pmod({at}, {stretch}L) AS _step")
        .selectExpr(
            "*",
            f"exp({log_keep} * _step) * sum(coalesce({term}, 0D) / exp({log_keep} * _step)) OVER ({so_far}) AS _local",
            f"lead(1) OVER ({in_order}) IS NULL AS _ends",
        )
        .selectExpr("*", f"CASE WHEN _ends THEN _local * exp({log_keep} * ({stretch} - _step)) END AS _leaves")
        .selectExpr(*rows.columns, f"_local + {carry} AS {out}")
    )


def low_pass(
    rows: DataFrame,
    value: str,
    span: int,
    within: list[str],
    index: str,
    length: str,
    special: str,
    out: str,
    position: str,
    enters: tuple[str, str] = ("0D", "0D"),
    bounds: tuple[str, str] | None = None,
) -> DataFrame:
    """Exponential mean forwards, then backwards over the result, of the rows of a group.

    One pass is y[i] = (1-a) y[i-1] + a x[i] with y[0] = x[0]. `index` numbers the non-null rows
    of the whole series and `length` counts them; `position` numbers all its rows. A group may
    be a block of a series: then `enters` are the results of the row before it forwards and of
    the row behind it backwards, and `bounds` the `index` of its first row and of the first row
    behind it. Nulls are skipped and get a null result. `special` is the sum of the NaN and
    infinite readings of the series: one of them carries through to every row.
    """
    weight = ema_weight(span)
    keep = f"({math.log1p(-weight)!r}D)"
    first, behind = bounds or ("0L", length)
    kept = rows.columns
    sample = f"IF({index} = 0, 1D, {weight!r}D) * {value}"
    rows = _decaying_sum(rows, sample, index, position, span, within, "_forward").selectExpr(
        *kept, f"_forward + {enters[0]} * exp({keep} * ({index} - {first} + 1)) AS _forward"
    )
    sample = f"IF({index} = {length} - 1, 1D, {weight!r}D) * IF({value} IS NULL, NULL, _forward)"
    from_end = f"({length} - {index})"
    rows = _decaying_sum(rows, sample, from_end, f"{position} DESC", span, within, "_both")
    both = f"_both + {enters[1]} * exp({keep} * ({behind} - {index}))"
    return rows.selectExpr(
        *kept, f"CASE WHEN {value} IS NOT NULL THEN coalesce({special}, {both}) END AS {out}"
    )


def carried_between_blocks(
    blocks: DataFrame, by: str, value: str, span: int, index: str, length: str
) -> DataFrame:
    """One row per (series, block): what the low-pass brings into the block on either side.

    A block maps what enters it to r^rows times that plus a sum of its own, forwards and then
    backwards, so it takes two sums over its rows, which need no order. Those few numbers are
    scanned along the series in both directions.

    `_in` is the forward result of the last row before the block, `_back` the final result of
    the first row behind it, `_first` and `_next` are the `index` of the first row in it and
    behind it.
    """
    a = ema_weight(span)
    keep = f"({math.log1p(-a)!r}D)"

    def power(n: str) -> str:
        return f"exp({keep} * ({n}))"

    def squares(n: str) -> str:
        """a times the sum of the first `n` even powers of r"""
        return f"(-expm1(2D * {keep} * ({n})) / {2.0 - a!r}D)"

    whole = f"PARTITION BY {by}, _block"
    term = f"IF({index} = 0, 1D, {a!r}D) * {value}"
    at_end = f"IF(_next = {length}, {1.0 - a!r}D, 0D)"
    # a row's part in the block's own result at its first row, after both passes
    back = f"{power('_s')} * {squares('_m - _s')} + {at_end} * {power('2 * (_m - 1) - _s')}"
    columns = ", ".join(blocks.columns)
    sums = (
        blocks.selectExpr(
            "*",
            f"min({index}) OVER ({whole}) AS _first",
            f"min({index}) OVER ({whole}) + count({value}) OVER ({whole}) AS _next",
        )
        .selectExpr("*", f"{index} - _first AS _s", "_next - _first AS _m")
        .groupBy(by, "_block")
        .agg(
            *map(
                F.expr,
                (
                    "max(_first) AS _first",
                    "max(_next) AS _next",
                    f"max({length}) AS _length",
                    f"coalesce(sum({term} * {power('_m - 1 - _s')}), 0D) AS _out",
                    f"coalesce(sum({term} * ({back})), 0D) AS _head",
                    # every column is read, so that both uses of the blocks share their shuffle
                    f"max(xxhash64({columns})) AS _seen",
                ),
            )
        )
    )
    along = f"PARTITION BY {by} ORDER BY _block"
    sums = sums.selectExpr("*", f"lag(_out) OVER ({along}) AS _comes")
    sums = _decaying_sum(sums, "_comes", "_first", "_block", span, [by], "_in")
    rows = "(_next - _first)"
    through = f"{power('1')} * ({squares(rows)} + IF(_next = _length AND {rows} > 0, {1.0 - a!r}D * {power(f'2 * ({rows} - 1)')}, 0D))"
    sums = sums.selectExpr("*", f"_head + _in * {through} AS _leads")
    sums = sums.selectExpr("*", f"lead(_leads) OVER ({along}) AS _goes")
    sums = _decaying_sum(sums, "_goes", "(_length - _next)", "_block DESC", span, [by], "_back")
    lost = "raise_error('a block lost its rows')"
    return sums.selectExpr(
        by, "_block", f"IF(_seen IS NULL, {lost}, _in) AS _in", "_back", "_first", "_next"
    )
