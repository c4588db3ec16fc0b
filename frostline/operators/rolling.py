"""Centred rolling means over rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_reach(window: int) -> tuple[int, int]:
    """Rows before and after the current one in a centred window."""
    if window >= 2**31:
        raise ValueError("a window has less than 2^31 rows")
    return window // 2, (window + 1) // 2 - 1


def rolling_mean(
    rows: DataFrame,
    value: str,
    window: int,
    within: list[str],
    position: str,
    out: str,
    min_rows: int = 1,
) -> DataFrame:
    """Add the mean of `value` over the `window` rows centred on each row.

    `position` numbers the rows of the whole series from 0, so a group may hold a part
    of a series with the rows its windows reach. Windows are cut off at the ends of the
    series. Nulls take up a row but are not averaged; with fewer than `min_rows` other
    values the result is null.

    The series is parted into stretches of `window` rows. A frame is the end of one
    stretch and the beginning of the next, so both are running sums of rows that all lie
    within the frame: its cost does not grow with the width, and nothing outside the
    frame, however large, is added and taken away again.
    """
    before, after = window_reach(window)
    group = ", ".join(within)
    stretch = f"PARTITION BY {group}, _stretch ORDER BY {position}"
    to_here = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    everything = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    order = f"PARTITION BY {group} ORDER BY {position}"
    parts = {"_sum": f"coalesce({value}, 0D)", "_count": f"IF({value} IS NULL, 0L, 1L)"}
    # the frame of row p begins at p - before; its stretch ends with it, at the end of
    # the series, or goes on in the next one
    begins, ends = f"{position} - {before}", f"least({position} + {after}, _last)"
    same = f"floor(({begins}) / {window}) = floor({ends} / {window})"

    def frame(p: str) -> str:
        head = f"coalesce(lead({p}_head, {after}) OVER ({order}), {p}_end)"
        tail = f"lag({p}_tail, {before}) OVER ({order})"
        return (
            f"CASE WHEN {position} < {before} THEN {head} "
            f"WHEN {same} THEN {tail} ELSE {tail} + {head} END AS {p}"
        )

    return (
        rows.selectExpr("*", f"floor({position} / {window}) AS _stretch")
        .selectExpr(
            "*",
            *[f"sum({x}) OVER ({stretch} DESC {to_here}) AS {p}_tail" for p, x in parts.items()],
        )
        .selectExpr(
            "*", *[f"sum({x}) OVER ({stretch} {to_here}) AS {p}_head" for p, x in parts.items()]
        )
        .selectExpr(
            "*",
            f"last({position}) OVER ({order} {everything}) AS _last",
            *[f"last({p}_head) OVER ({order} {everything}) AS {p}_end" for p in parts],
        )
        .selectExpr(*rows.columns, *map(frame, parts))
        .selectExpr(
            *rows.columns,
            f"CASE WHEN _count >= {max(min_rows, 1)} THEN _sum / _count END AS {out}",
        )
    )


def block_rolling_mean(
    blocks: DataFrame, by: str, value: str, window: int, block_rows: int, out: str, min_rows: int = 1
) -> DataFrame:
    """A rolling mean over what `blocks_for` gives for this window; the home rows come back."""
    if window > block_rows:
        return wide_rolling_mean(blocks.where("_home"), by, value, window, block_rows, out, min_rows)
    return rolling_mean(blocks, value, window, [by, "_block"], "_pos", out, min_rows).where("_home")


def wide_rolling_mean(
    rows: DataFrame,
    by: str,
    value: str,
    window: int,
    block_rows: int,
    out: str,
    min_rows: int = 1,
) -> DataFrame:
    """The same for windows wider than a block, over blocks without margins.

    A frame is the end of one block, whole blocks, and the beginning of another. Ends and
    beginnings are running sums within a block; each is sent to the one row whose frame begins
    or ends there, by its number in the series. Sums of whole blocks are added up over one row
    per block, for each number of blocks a frame of such a row can hold. So a task sees a block,
    whatever the width, and again nothing outside a frame is added and taken away.
    """
    before, after = window_reach(window)
    inside = f"PARTITION BY {by}, _block ORDER BY _pos"
    to_here = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    parts = {"_sum": f"coalesce({value}, 0D)", "_count": f"IF({value} IS NULL, 0L, 1L)"}
    running = [f"sum({x}) OVER ({inside} {to_here}) AS {p}_head" for p, x in parts.items()]
    running += [f"sum({x}) OVER ({inside} DESC {to_here}) AS {p}_tail" for p, x in parts.items()]
    local = rows.selectExpr(by, "_block", "_pos", *running)
    shift = {"tail": before, "head": -after}
    ends = {
        part: local.selectExpr(
            f"{by} AS _by_{part}", f"_pos + {by_rows} AS _at_{part}", f"_sum_{part}", f"_count_{part}"
        )
        for part, by_rows in shift.items()
    }

    # blocks between those of the first and the last row of a frame, seen from the row's own
    firsts = sorted({(step - before) // block_rows + 1 for step in (0, block_rows - 1)})
    lasts = sorted({(step + after) // block_rows - less for step in (0, block_rows - 1) for less in (0, 1)})
    spans = [(a, z) for a in firsts for z in lasts if a <= z]
    along = f"PARTITION BY {by} ORDER BY _block"

    def edge(n: int) -> str:
        return f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    sums = [f"sum({x}) AS _block{p}" for p, x in parts.items()]
    blocks = rows.groupBy(by, "_block").agg(*map(F.expr, sums)).selectExpr(
        f"{by} AS _by",
        "_block AS _number",
        *[
            f"sum(_block{p}) OVER ({along} RANGE BETWEEN {edge(a)} AND {edge(z)}) AS {p}_{i}"
            for i, (a, z) in enumerate(spans)
            for p in parts
        ],
    )
    first = f"floor((_pos - {before}) / {block_rows}) + 1 - _block"
    last = f"floor((_pos + {after}) / {block_rows}) - IF(_pos + {after} < _rows, 1, 0) - _block"

    def whole(p: str) -> str:
        cases = " ".join(f"WHEN _a = {a} AND _z = {z} THEN {p}_{i}" for i, (a, z) in enumerate(spans))
        return f"CASE {cases} END AS {p}_whole" if cases else f"NULL AS {p}_whole"

    found = (
        rows.join(blocks, F.expr(f"{by} = _by AND _block = _number"), "left")
        .selectExpr(*rows.columns, *[f"{p}_{i}" for i in range(len(spans)) for p in parts], f"{first} AS _a", f"{last} AS _z")
        .selectExpr(*rows.columns, *map(whole, parts))
    )
    for part, other in ends.items():
        found = found.join(other, F.expr(f"{by} = _by_{part} AND _pos = _at_{part}"), "left")
    total = {p: " + ".join(f"coalesce({p}_{x}, 0)" for x in ("tail", "whole", "head")) for p in parts}
    return found.selectExpr(*rows.columns, *[f"{x} AS {p}" for p, x in total.items()]).selectExpr(
        *rows.columns, f"CASE WHEN _count >= {max(min_rows, 1)} THEN _sum / _count END AS {out}"
    )
