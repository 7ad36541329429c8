"""What each filter removes in every order of filters, from one walk over all filter sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Maximal runs of anything but space and the control characters 9 to 13."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


#: Conditions on which a text fails, in the order of their letters.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, found: F.size(found) < 200,
    "B": lambda text, found: F.size(F.array_distinct(found)) * 100 < F.size(found) * 50,
    "C": lambda text, found: F.length(F.regexp_replace(text, "[^A-Z]", "")) * 100 > F.length(text) * 3,
    "D": lambda text, found: text.rlike(r"[#$%&*|]"),
}
#: The filter that looks at the whole table: the text of a smaller ``doc_id`` is the same.
REPEATED = "E"
COUNTS = ("n", "good", "toxic")
_REPORT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def flags(docs: DataFrame, filters: Mapping[str, Callable] = FILTERS) -> DataFrame:
    """``doc_id, part, digest, mask``: bit i of ``mask`` is set where filter i fails.

    A null text counts as empty, a null ``lang`` as the part with the empty name.
    ``digest`` is the SHA-256 of the text.  Other columns take no part.
    """
    plain = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("found", words(F.col("text")))
    bits = [
        F.when(fails(F.col("text"), F.col("found")), F.lit(1 << i)).otherwise(F.lit(0))
        for i, fails in enumerate(filters.values())
    ]
    return plain.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")
    )


def mask_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable] = FILTERS) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of every part by the filters they fail.

    The highest bit is the repeated text.  A document is good or toxic if any row of
    ``labels`` for its id says so.  Rows that repeat a document, id included, are
    documents each, and none of them is smaller than the other; a document without
    an id has no labels and no smaller one.  Rows are added up before every exchange
    and texts stay where they are, so a text that a third of all rows share costs no
    more than others.
    """
    told = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    alike = ("digest", "mask", "part")
    copies = flags(docs, filters).groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    marked = copies.join(told, "doc_id", "left").select(
        *alike,
        "doc_id",
        "n",
        *[(F.col("n") * F.coalesce(F.col(f"is_{c}"), F.lit(0))).alias(c) for c in COUNTS[1:]],
    )
    same = marked.groupBy(*alike).agg(
        F.min("doc_id").alias("first"),
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.min_by(c, "doc_id").alias(f"first_{c}") for c in COUNTS],
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"no_id_{c}") for c in COUNTS],
    )
    leads = F.col("first") == F.min("first").over(Window.partitionBy("digest"))
    new = [
        (F.col(f"no_id_{c}") + F.when(F.col("leads"), F.col(f"first_{c}")).otherwise(0)).alias(c) for c in COUNTS
    ]
    parted = same.withColumn("leads", leads).select(
        "part",
        F.explode(
            F.array(
                F.struct(F.col("mask"), *new),
                F.struct(
                    (F.col("mask") + (1 << len(filters))).alias("mask"),
                    *[(F.col(c) - value).alias(c) for c, value in zip(COUNTS, new, strict=True)],
                ),
            )
        ).alias("cell"),
    )
    return parted.groupBy("part", "cell.mask").agg(*[F.sum(f"cell.{c}").alias(c) for c in COUNTS])


def survivors(cells: np.ndarray) -> np.ndarray:
    """What is left under every set of filters; ``cells[mask]`` holds counts by failed filters.

    The sets are walked in Gray code, so one filter is switched at a time.  Each cell
    counts the active filters it fails: it leaves when that becomes one and comes back
    when it becomes none again.  ``out[active]`` is the state of that set.
    """
    masks = np.arange(len(cells))
    failing = np.zeros(len(cells), np.int64)
    out = np.empty_like(cells)
    now, active = cells.sum(axis=0), 0
    out[0] = now
    for step in range(1, len(cells)):
        switched = step & -step
        active ^= switched
        fails = masks & switched != 0
        if active & switched:
            now = now - cells[fails & (failing == 0)].sum(axis=0)
            failing[fails] += 1
        else:
            failing[fails] -= 1
            now = now + cells[fails & (failing == 0)].sum(axis=0)
        out[active] = now
    return out


def order_table(names: str) -> pd.DataFrame:
    """Every order and step of the filters: the sets before and after, and the step's filter."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, start=1):
            after = before | 1 << f
            rows.append(("".join(names[i] for i in order), step, f, before, after))
            before = after
    return pd.DataFrame(rows, columns=["filter_order", "step", "f", "before", "after"])


def audit(cells: DataFrame, names: str) -> DataFrame:
    """One row per part, order of filters and step, zeros included, from ``mask_cells``.

    ``shapley`` is what the step's filter removes over all orders together.  No cells
    give no rows.  A part is at most ``2**len(names)`` rows, and parts go to tasks by
    name; the walk itself sees only those.
    """
    size = 1 << len(names)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = order_table(names)
        f, before, after = (table[c].to_numpy() for c in ("f", "before", "after"))
        for batch in batches:
            for part, found in zip(batch["part"], batch["found"], strict=True):
                counts = np.zeros((size, len(COUNTS)), np.int64)
                for cell in found:
                    counts[cell["mask"]] = [cell[c] for c in COUNTS]
                left = survivors(counts)
                lost = left[before] - left[after]
                alone = np.array([left[(size - 1) ^ (1 << i)][0] - left[-1][0] for i in range(len(names))])
                fails = np.array([left[0][0] - left[1 << i][0] for i in range(len(names))])
                shapley = np.array([lost[f == i, 0].sum() for i in range(len(names))])
                yield pd.DataFrame(
                    {
                        "part": part,
                        "filter_order": table["filter_order"],
                        "step": table["step"].astype("int32"),
                        "kept": left[after][:, 0],
                        "removed": lost[:, 0],
                        "redundant": fails[f] - lost[:, 0],
                        "unique_fails": alone[f],
                        "good_lost": lost[:, 1],
                        "toxic_lost": lost[:, 2],
                        "shapley": shapley[f],
                    }
                )

    found = F.collect_list(F.struct("mask", *COUNTS)).alias("found")
    return cells.groupBy("part").agg(found).mapInPandas(report, _REPORT)


def filter_interactions(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable] = FILTERS) -> DataFrame:
    """The audit of the given filters and of repeated texts, over all documents and all orders."""
    return audit(mask_cells(docs, labels, filters), "".join(filters) + REPEATED)


ORACLE = r"""
WITH plain AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS found,
         min(doc_id) OVER (PARTITION BY text) AS first FROM plain),
told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part,
         CAST(len(found) < 200 AS int)
         + 2 * CAST(100 * len(list_distinct(found)) < 50 * len(found) AS int)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS int)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS int)
         + 16 * CAST(coalesce(doc_id > first, FALSE) AS int) AS mask,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM split LEFT JOIN told USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit,
         coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before::int | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before::int = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before::int <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before::int = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before::int = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS int) AS step, CAST(kept AS bigint) AS kept,
       CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant,
       CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost,
       CAST(toxic_lost AS bigint) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley
FROM counted
"""
