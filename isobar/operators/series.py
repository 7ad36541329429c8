"""Ordered-series building blocks that never need a whole series in one task.

A series is the rows of one key ordered by time, and one key may hold a large
share of all rows.  So no window here runs over a whole series.  Two ways of
cutting it are used:

* calendar cells, ``(keys, bucket)``: what must cross a cell border (row counts,
  the last or first known value) is summarised to one row per cell, carried
  along the small summary, and joined back on the cell, where the big side is
  already partitioned;
* position blocks, ``(keys, block)``: rows are numbered along the series and cut
  into blocks of fixed size; every block also receives the few neighbouring rows
  its frames reach, so any bounded frame (lag, rolling mean) is exact inside it.

Summary windows run over one row per cell, at most a few thousand per key for
any calendar.  Pick ``unit`` so that one cell fits a task: a month holds 744
hourly rows, a day 86,400 rows of one-second readings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
BLOCK = "_block"
CORE = "_core"
POSITION = "_pos"
LENGTH = "_n"

_PAST = Window.unboundedPreceding
_BEFORE = "_before"
_ROWS = "_rows"


def bucket_of(time: Column, unit: str) -> Column:
    """Calendar cell of a timestamp: ``day``, ``month``, ``quarter`` or ``year``."""
    day = F.to_date(time)
    return day if unit == "day" else F.trunc(day, unit)


def names(columns: Sequence[str]) -> str:
    """Column names quoted for SQL text."""
    return ", ".join(f"`{c}`" for c in columns)


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def keep_methods_compiled(spark: SparkSession) -> None:
    """Let the engine fuse operators only into methods that the JVM compiles.

    The JVM interprets methods of more than 8,000 bytes of bytecode for good, and filling a
    wide table makes longer ones; the engine's own limit, left alone if anybody has set it, is
    65,535.
    """
    if spark.conf.get(_METHOD_LIMIT) == "65535":
        spark.conf.set(_METHOD_LIMIT, "8000")


def in_cells(
    df: DataFrame, keys: Sequence[str], time: str, unit: str, cell: str | None = None
) -> DataFrame:
    """Add the cell ``_bucket``; rows without a key or a time belong to no series.

    ``cell`` names a column that already cuts the series in order, such as the
    block the rows are partitioned by.

    The filter names every cell column although the joins on the cell imply it:
    stated here, it stands in each branch of the plan alike, and branches that
    are alike share one exchange.
    """
    keep_methods_compiled(df.sparkSession)
    bucket = F.col(cell) if cell else bucket_of(F.col(time), unit)
    every = " AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, time, BUCKET))
    return df.withColumn(BUCKET, bucket).where(every)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    time: str = "time",
    unit: str = "year",
    totals: Mapping[str, tuple[Column, object]] | None = None,
) -> DataFrame:
    """Number the rows of each series (``_pos``, from 0) and add its length ``_n``.

    ``totals`` adds per-key figures in the same pass: a name mapped to an
    aggregate for one cell and the function that merges cells.  Rows without a
    time are dropped.
    """
    totals = totals or {}
    cell = [*keys, BUCKET]
    keyed = in_cells(df, keys, time, unit)
    whole = Window.partitionBy(*keys)
    along = whole.orderBy(BUCKET).rowsBetween(_PAST, 0)
    sizes = (
        keyed.groupBy(*cell)
        .agg(
            F.count(F.lit(1)).alias(_ROWS),
            *[part.alias(name) for name, (part, _) in totals.items()],
        )
        .select(
            *cell,
            (F.sum(_ROWS).over(along) - F.col(_ROWS)).alias(_BEFORE),
            F.sum(_ROWS).over(whole).alias(LENGTH),
            *[merge(name).over(whole).alias(name) for name, (_, merge) in totals.items()],
        )
    )
    inside = Window.partitionBy(*cell).orderBy(time)
    return (
        keyed.join(sizes, cell)
        .withColumn(POSITION, F.col(_BEFORE) + F.row_number().over(inside) - 1)
        .drop(BUCKET, _BEFORE)
    )


def with_blocks(
    df: DataFrame,
    keys: Sequence[str],
    before: int = 0,
    after: int = 0,
    block_rows: int = 8192,
) -> DataFrame:
    """Copy each row of a positioned series into every block whose frames reach it.

    ``before`` and ``after`` are how many rows a frame looks back and ahead.
    ``_core`` marks the one copy that belongs to its block; the others are
    context, to be dropped with :func:`core_only` once the frames are computed.
    Blocks are as long as the longest frame at least, so one reaches no further
    than the next.
    """
    block_rows = max(block_rows, before, after)
    own = F.floor(F.col(POSITION) / block_rows)
    inside = F.col(POSITION) % block_rows
    targets = [own]
    if before:
        later_exists = (own + 1) * block_rows < F.col(LENGTH)
        targets.append(F.when((inside >= block_rows - before) & later_exists, own + 1))
    if after:
        targets.append(F.when((inside < after) & (own > 0), own - 1))
    if len(targets) == 1:
        return df.withColumn(BLOCK, own).withColumn(CORE, F.lit(True))
    return df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets)))).withColumn(
        CORE, F.col(BLOCK) == own
    )


def with_day_blocks(
    df: DataFrame, time: str = "time", before: int = 0, block_rows: int = 8192
) -> DataFrame:
    """:func:`with_blocks` for a gap-free daily series.

    One row a day makes the day number a position, so the rows need no counting:
    this is a projection, and the window over the blocks is the only exchange.
    """
    block_rows = max(block_rows, before)
    day = F.unix_date(F.to_date(time)).cast("long")
    own = F.floor(F.col(POSITION) / block_rows)
    into_next = F.when(F.pmod(F.col(POSITION), F.lit(block_rows)) >= block_rows - before, own + 1)
    return (
        df.withColumn(POSITION, day)
        .withColumn(BLOCK, F.explode(F.array_compact(F.array(own, into_next))))
        .withColumn(CORE, F.col(BLOCK) == own)
    )


def block_window(keys: Sequence[str]):
    """Window over one block in series order."""
    return Window.partitionBy(*keys, BLOCK).orderBy(POSITION)


def block_arrays(blocks: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per block of :func:`with_blocks`: its values in series order as the array
    ``_values``, led by ``_context`` rows of the block before.

    What a frame of any shape needs of a block is then one array of bounded length.
    """
    rows = F.sort_array(F.collect_list(F.struct(POSITION, column)))
    return blocks.groupBy(*keys, BLOCK).agg(
        F.count_if(~F.col(CORE)).cast("int").alias("_context"), rows.alias("_rows")
    ).select(*keys, BLOCK, "_context", F.col(f"_rows.{column}").alias("_values"))


def core_only(df: DataFrame, *also_drop: str) -> DataFrame:
    """Drop context copies and the bookkeeping columns."""
    return df.where(CORE).drop(BLOCK, CORE, *also_drop)


_MOMENT_PARTS = ("first", "first_at", "last", "last_at", "s1", "s2")


def _line_sums(
    start: str, start_at: str, end: str, end_at: str, alone: str, lone_rows: int | str
) -> tuple[str, str]:
    """SQL sums of values and squares on the straight line after ``start`` up to ``end``.

    Without a start, ``lone_rows`` rows have the value ``alone``.
    """
    g, d = f"CAST({end_at} - {start_at} AS DOUBLE)", f"({end} - {start})"
    first = f"{g} * {start} + {d} * ({g} + 1) / 2"
    second = (
        f"{g} * {start} * {start} + {start} * {d} * ({g} + 1) "
        f"+ {d} * {d} * ({g} + 1) * (2 * {g} + 1) / (6 * {g})"
    )
    lone = f"CASE WHEN {start_at} IS NULL THEN {lone_rows} * {alone}"
    return f"{lone} ELSE {first} END", f"{lone} * {alone} ELSE {second} END"


def _with_moments(cells: DataFrame, in_series: str, columns: Sequence[str]) -> DataFrame:
    """Whole-series mean and deviation of gap-filled columns, from one row per cell.

    A cell's own sums cover its first to last known row, of values less the first
    known one.  They are moved to one reference per series, the least of these
    firsts, so sums and squares stay as small as the series' spread and no digits
    cancel at high levels.  To them come the gap that leads to the cell's first
    known row, and after the last known row of all the level rest of the series.
    """
    cells = cells.selectExpr(
        "*", *[f"min(`_first_{c}`) OVER ({in_series}) AS `_ref_{c}`" for c in columns]
    )
    parts = (*_MOMENT_PARTS, "ref")
    other = [c for c in cells.columns if not any(c == f"_{n}_{x}" for n in parts for x in columns)]
    totals = []
    for c in columns:
        first, first_at = f"(`_first_{c}` - `_ref_{c}`)", f"({_BEFORE} + `_first_at_{c}`)"
        last, last_at = f"(`_last_{c}` - `_ref_{c}`)", f"({_BEFORE} + `_last_at_{c}`)"
        start = f"(`_carry_prev_{c}` - `_ref_{c}`)"
        gap = _line_sums(start, f"`_carry_prev_at_{c}`", first, first_at, first, first_at)
        rows = f"(`_last_at_{c}` - `_first_at_{c}` + 1)"
        own = {
            "s1": f"`_s1_{c}` + {rows} * {first}",
            "s2": f"`_s2_{c}` + 2 * {first} * `_s1_{c}` + {rows} * {first} * {first}",
        }
        rest = f"CASE WHEN `_carry_next_at_{c}` IS NULL THEN {LENGTH} - {last_at} ELSE 0 END"
        for power, line in (("s1", gap[0]), ("s2", gap[1])):
            value = {"s1": "{0}", "s2": "{0} * {0}"}[power]
            known = f"{own[power]} + {line} - {value.format(first)} + {rest} * {value.format(last)}"
            totals.append(f"sum({known}) OVER ({in_series}) AS `_{power}_{c}`")
        totals.append(f"`_ref_{c}`")
    summed = cells.selectExpr(*[f"`{c}`" for c in other], *totals)
    n = LENGTH
    return summed.selectExpr(
        *[f"`{c}`" for c in other if c != LENGTH],
        *[f"`_ref_{c}` + `_s1_{c}` / {n} AS `_mean_{c}`" for c in columns],
        *[
            f"nullif(sqrt(greatest(try_divide(`_s2_{c}` - `_s1_{c}` * `_s1_{c}` / {n}, {n} - 1), 0D)),"
            f" 0D) AS `_std_{c}`"
            for c in columns
        ],
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    time: str = "time",
    unit: str = "month",
    positions: Sequence[str] = (),
    next_time: bool = False,
    cell: str | None = None,
    moments: Sequence[str] = (),
) -> DataFrame:
    """Nearest known value at or before, and at or after, each row.

    Adds ``_prev_<c>`` and ``_next_<c>`` for each column, for ``positions`` also
    the rows they stand in (``_prev_at_<c>``, ``_next_at_<c>``), plus ``_pos``
    from 1 and the cell ``_bucket``; ``next_time`` adds ``_next_time``, the time
    of the following row.  The result stays partitioned by ``(keys, _bucket)``,
    so the caller can go on inside the cell for free.  ``cell`` as in
    :func:`in_cells`.

    ``moments``, a part of ``positions``, adds ``_mean_<c>`` and ``_std_<c>``:
    mean and sample deviation of the whole series as it will be once its gaps
    are filled linearly (deviation null when zero or undefined).  A straight gap
    has a closed sum, so these come out of the summary as well, without filling
    anything first.
    """
    # Written as SQL text: one call per expression instead of one per operator
    # keeps building the plan of a wide table fast.
    in_cell = f"PARTITION BY {names([*keys, BUCKET])}"
    in_series = f"PARTITION BY {names(keys)}"
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    up = f"({in_cell} ORDER BY `{time}` {so_far})"
    onward = f"({in_cell} ORDER BY `{time}`)"
    past = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    earlier = f"({in_series} ORDER BY {BUCKET} {past})"
    later = f"({in_series} ORDER BY {BUCKET} DESC {past})"
    rank = "_rank"

    def known(c: str) -> str:
        return f"CASE WHEN `{c}` IS NOT NULL THEN {rank} END"

    keyed = in_cells(df, keys, time, unit, cell)
    ranked = keyed.selectExpr("*", f"row_number() OVER ({in_cell} ORDER BY `{time}`) AS {rank}")

    before_row = f"({in_cell} ORDER BY `{time}` {past})"
    measured = ranked
    if moments:
        measured = ranked.selectExpr(
            "*",
            *[f"last(`{c}`, true) OVER {before_row} AS `_from_{c}`" for c in moments],
            *[f"last({known(c)}, true) OVER {before_row} AS `_from_at_{c}`" for c in moments],
            *[f"first(`{c}`, true) OVER {up} AS `_base_{c}`" for c in moments],
        )
    edges = measured.groupBy(*keys, BUCKET).agg(
        F.expr(f"count(1) AS {_ROWS}"),
        *[F.expr(f"min_by(`{c}`, {known(c)}) AS `_first_{c}`") for c in columns],
        *[F.expr(f"max_by(`{c}`, {known(c)}) AS `_last_{c}`") for c in columns],
        *[F.expr(f"min({known(c)}) AS `_first_at_{c}`") for c in positions],
        *[F.expr(f"max({known(c)}) AS `_last_at_{c}`") for c in positions],
        *([F.expr(f"min(`{time}`) AS _start")] if next_time else []),
        *[
            F.expr(f"sum({part}) AS `_{power}_{c}`")
            for c in moments
            for power, part in zip(
                ("s1", "s2"),
                _line_sums(
                    f"(`_from_{c}` - `_base_{c}`)", f"`_from_at_{c}`",
                    f"(`{c}` - `_base_{c}`)", rank, f"(`{c}` - `_base_{c}`)", 1,
                ),
                strict=True,
            )
        ],
    )
    numbered = edges.selectExpr("*", f"coalesce(sum({_ROWS}) OVER {earlier}, 0) AS {_BEFORE}")
    carried = numbered.selectExpr(
        *[f"`{c}`" for c in (*keys, BUCKET, _BEFORE)],
        *[f"last(`_last_{c}`, true) OVER {earlier} AS `_carry_prev_{c}`" for c in columns],
        *[f"last(`_first_{c}`, true) OVER {later} AS `_carry_next_{c}`" for c in columns],
        *[
            f"last({_BEFORE} + `_last_at_{c}`, true) OVER {earlier} AS `_carry_prev_at_{c}`"
            for c in positions
        ],
        *[
            f"last({_BEFORE} + `_first_at_{c}`, true) OVER {later} AS `_carry_next_at_{c}`"
            for c in positions
        ],
        *(
            [f"lead(_start) OVER ({in_series} ORDER BY {BUCKET}) AS _carry_time"]
            if next_time
            else []
        ),
        *[f"`_{name}_{c}`" for c in moments for name in _MOMENT_PARTS],
        *([f"sum({_ROWS}) OVER ({in_series}) AS {LENGTH}"] if moments else []),
    )
    if moments:
        carried = _with_moments(carried, in_series, moments)
    # Looking ahead by ``lead`` keeps the one order of the cell: no second sort.
    local = ranked.selectExpr(
        "*",
        *[f"last(`{c}`, true) OVER {up} AS `_prev_{c}`" for c in columns],
        *[f"last({known(c)}, true) OVER {up} AS `_prev_at_{c}`" for c in positions],
        *[f"coalesce(`{c}`, lead(`{c}`) IGNORE NULLS OVER {onward}) AS `_next_{c}`" for c in columns],
        *[
            f"coalesce({known(c)}, lead({known(c)}) IGNORE NULLS OVER {onward}) AS `_next_at_{c}`"
            for c in positions
        ],
        *([f"lead(`{time}`) OVER {onward} AS _following"] if next_time else []),
    )
    sides = ("prev", "next")
    return local.join(carried, [*keys, BUCKET]).selectExpr(
        *[f"`{c}`" for c in keyed.columns],
        f"{_BEFORE} + {rank} AS {POSITION}",
        *[
            f"coalesce(`_{s}_{c}`, `_carry_{s}_{c}`) AS `_{s}_{c}`" for c in columns for s in sides
        ],
        *[
            f"coalesce({_BEFORE} + `_{s}_at_{c}`, `_carry_{s}_at_{c}`) AS `_{s}_at_{c}`"
            for c in positions
            for s in sides
        ],
        *(["coalesce(_following, _carry_time) AS _next_time"] if next_time else []),
        *[f"`_{name}_{c}`" for c in moments for name in ("mean", "std")],
    )
