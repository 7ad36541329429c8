"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import use_checkpoints


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges; the root is the smallest node reached.

    Each round links every node's larger neighbours to its smallest one, then its
    smaller neighbours likewise.  Minima are partial sums, joins are on the node, so
    a node with very many neighbours is split by the engine's skew join; nothing is
    gathered in a group.  A round ends in a reliable checkpoint.  Rounds go on until
    the edges stay as they are.  No edges give no rows; loops and repeated edges
    count once.
    """
    use_checkpoints(edges.sparkSession)
    now = (
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ).checkpoint()
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("e"))
            .select("e.a", F.col("e.low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now, last = small.checkpoint(), mark
        mark = _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
