"""Bounded samples for fitting, without one task or the driver seeing more than them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest(rows: DataFrame, mark: str, sample: int) -> DataFrame:
    """The rows of the least hashes ``mark``: ``sample`` of them, or all, and hardly any more.

    Counts by the first bits, then by the next ones where the sample ends, say which
    these are, so a task has its share of the sample and not a whole one.
    """
    taken, end = 0, None
    for bits in (16, 32):
        part = F.shiftrightunsigned(mark, 64 - bits)
        inside = rows if end is None else rows.where(F.shiftrightunsigned(mark, 80 - bits) == end)
        for r in sorted(inside.groupBy(part.alias("part")).count().collect()):
            if taken + r["count"] >= sample:
                end = r.part
                break
            taken += r["count"]
        else:
            return rows
    return rows.where(F.shiftrightunsigned(mark, 32) <= end)
