"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
task.  Here a mergeable sketch only says where a quantile should lie.  One pass over
the values then counts what is below that range and keeps the values inside it, so
the rank is verified, and only a small step of the range is put in order.

Sketches may be stored, per station and month say, and rolled up to any coarser group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

# Size of a sketch.  It is exact for groups of no more values, and off by some 0.13
# percent of the ranks in 99 of 100 larger ones, whatever the values are.
SKETCH_SIZE = 4000
# Kept on either side of the wanted rank: eight times that, some twenty standard errors.
_MARGIN = 0.01
# Groups in which the margin is less than four ranks are taken whole.
_WHOLE = 400
# A range is cut into so many steps of equal width; only the steps that hold the
# wanted ranks are ordered value by value.
_STEPS = 4096
#: Columns of a sketch table beside its group.
SKETCH_COLUMNS = ("sketch", "sketch_n", "sketch_least", "sketch_most")
_BELOW = -1


def quantile_sketches(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per group that says roughly where each rank of its values lies.

    Missing values and NaN do not count.
    """
    known = _known(df, group, value)
    return known.groupBy(*group).agg(
        F.kll_sketch_agg_double("_v", SKETCH_SIZE).alias("sketch"),
        F.count("_v").alias("sketch_n"),
        F.min("_v").alias("sketch_least"),
        F.max("_v").alias("sketch_most"),
    )


def rolled_up(sketches: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*group).agg(
        F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"),
        F.sum("sketch_n").alias("sketch_n"),
        F.min("sketch_least").alias("sketch_least"),
        F.max("sketch_most").alias("sketch_most"),
    )


def _known(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    number = F.col(value).cast("double")
    return df.select(*group, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _range(q: float) -> Column:
    """Where the sketch puts a quantile; the whole group if that is small."""
    whole = F.col("sketch_n") <= _WHOLE

    def edge(at: float, end: str) -> Column:
        if not 0.0 < at < 1.0:
            return F.col(end)
        placed = F.kll_sketch_get_quantile_double("sketch", F.lit(float(at)))
        return F.when(whole, F.col(end)).otherwise(placed)

    return F.struct(
        edge(q - _MARGIN, "sketch_least").alias("low"),
        edge(q + _MARGIN, "sketch_most").alias("high"),
        (F.lit(float(q)) * (F.col("sketch_n") - 1)).alias("rank"),
    )


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    sketches: DataFrame | None = None,
) -> DataFrame:
    """One row per group with a column per wanted quantile, linear between ranks.

    ``sketches`` are stored ones of the same values, by this group or by finer ones;
    otherwise they are made first.  Should a rank not lie where its sketch puts it, which
    is to be expected once in more than 10^50 groups, or if the sketches are of other
    values, the query ends with an error and not with a wrong value.

    Ranges and the values inside them are stored first: sketches are random, so they must
    not be made anew for a second reader or after a loss.  The size of the ranges is then
    known, and the values are shuffled to meet them only if they are too many to broadcast.
    """
    group = list(group)
    names = sorted(wanted, key=wanted.get)
    made = quantile_sketches(df, group, value) if sketches is None else rolled_up(sketches, group)
    keys = [f"_g{i}" for i in range(len(group))]
    renamed = dict(zip(group, keys, strict=True))
    ranges = stored(made.select(*group, F.array(*[_range(wanted[n]) for n in names]).alias("_ranges")), "ranges")
    # A null key is a group too.
    same = F.lit(True)
    for own, other in renamed.items():
        same = same & F.col(own).eqNullSafe(F.col(other))
    def with_ranges(rows: DataFrame) -> DataFrame:
        if group:
            return rows.join(ranges.withColumnsRenamed(renamed), same).drop(*keys)
        return rows.withColumn("_one", F.lit(1)).join(ranges.withColumn("_one", F.lit(1)), "_one").drop("_one")

    placed = with_ranges(_known(df, group, value))

    # Values in no range only count, by how many ranges end below them.
    inside = F.exists("_ranges", lambda r: F.col("_v").between(r["low"], r["high"]))
    passed = F.size(F.filter("_ranges", lambda r: F.col("_v") > r["high"]))
    counted = (
        placed.withColumn("_passed", passed)
        .withColumn("_v", F.when(inside, F.col("_v")))
        .groupBy(*group, "_v", "_passed")
        .agg(F.count(F.lit(1)).alias("_c"))
    )

    def step(r: Column) -> Column:
        """Step of a value in a range: ``_BELOW`` before it, null behind it."""
        v, width = F.col("_v"), r["high"] - r["low"]
        within = F.least(F.floor((v - r["low"]) / width * _STEPS), F.lit(_STEPS - 1))
        return (
            F.when(F.col("_passed") > F.col("_i"), F.lit(None))
            .when(v.isNull() | (v < r["low"]), F.lit(_BELOW))
            .when(r["high"] > r["low"], F.coalesce(within, F.lit(0)))
            .otherwise(F.lit(0))
        )

    # The ranges come back to the few rows left: carried through the count, an array
    # would make it sort all values.
    ranked = with_ranges(stored(counted, "ranked")).select(
        *group, "_v", "_passed", "_c", F.posexplode("_ranges").alias("_i", "_r")
    )
    steps = ranked.select(
        *group, "_i", "_v", "_c", F.col("_r.rank").alias("_rank"), step(F.col("_r")).cast("int").alias("_step")
    ).where(F.col("_step").isNotNull())

    per_range = [*group, "_i"]
    every = Window.partitionBy(*per_range)
    upto = every.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    lower, upper = F.floor("_rank"), F.ceil("_rank")
    start = F.sum("_in_step").over(upto) - F.col("_in_step")
    outside = ((F.col("_step") == _BELOW) & (F.col("_in_step") > lower)) | (F.col("_upto_high") <= upper)
    found = (
        steps.groupBy(*per_range, "_rank", "_step")
        .agg(F.sum("_c").alias("_in_step"))
        .withColumns({"_start": start, "_upto_high": F.sum("_in_step").over(every)})
        .withColumn(
            "_start",
            F.when(outside, F.raise_error(F.lit("a rank lies outside the range its sketch names")).cast("long"))
            .otherwise(F.col("_start")),
        )
        .where((F.col("_start") <= upper) & (F.col("_start") + F.col("_in_step") > lower))
        .select(*per_range, "_step", "_start")
    )
    own = {c: f"_s{c}" for c in (*per_range, "_step")}
    same_step = F.lit(True)
    for c, other in own.items():
        same_step = same_step & F.col(c).eqNullSafe(F.col(other))
    order = Window.partitionBy(*per_range, "_step").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    covered = (
        steps.where(F.col("_step") != _BELOW)
        .join(found.withColumnsRenamed(own), same_step)
        .withColumn("_upto", F.col("_start") + F.sum("_c").over(order))
    )

    def at(rank: Column) -> Column:
        """Smallest value that covers a zero-based rank."""
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))

    picked = covered.groupBy(*per_range).agg(
        at(lower).alias("_a"), at(upper).alias("_b"), F.min(F.col("_rank") - lower).alias("_f")
    )
    # Equal neighbours need no line between them, and infinite ones allow none.
    exact = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    )
    return picked.groupBy(*group).agg(
        *[F.max(F.when(F.col("_i") == names.index(n), exact)).alias(n) for n in wanted]
    )
