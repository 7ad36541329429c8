"""A bitmap of fixed size over hashes, to leave out most rows before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**22 bits are 512 KB whatever the data: what a task gets has a fixed size.
BITS = 22


def bitmap(rows: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bits set at the lowest ``bits`` of every value of a long column.

    At most ``2**bits / 64`` rows, one per word, reach the driver.  A value that is
    in ``rows`` is always found again; another may be found too, and the join that
    follows drops it.
    """
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        rows.where(F.col(column).isNotNull())
        .select((F.shiftright(place, 6)).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("set"))
        .collect()
    )
    out = np.zeros(1 << bits - 6, np.int64)
    for r in words:
        out[r.word] = r.set
    return out.view(np.uint64)


def found(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of these 64-bit values may be in the bitmap."""
    place = values & np.uint64(len(known) * 64 - 1)
    return (known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
