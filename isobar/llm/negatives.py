"""Hard negatives by exact integer scores from residues: several small float32 products per score."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import use_checkpoints

#: Float32 holds every whole number up to here; the margin lets a residue be taken off exactly.
EXACT = (1 << 24) - 4096
#: Components that one float32 product adds up.
SPAN = 1024
#: Largest score for which ``90 * score`` still fits a long.
MOST = 1 << 55
#: Bytes of an anchor block's residues and running best scores in a task.
BLOCK_BYTES = 64 << 20
#: Anchors and rows of one product.
TILE = (256, 2048)

_NONE = np.iinfo(np.int64).min + 1
_PACKED = "vec_id bigint, label bigint, wide boolean, v binary, dim int, norm double"
_FOUND = "anchor_id bigint, key bigint, slot int, positive_id bigint, positive_score bigint, other_id bigint, score bigint"


def pack(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, label, wide, v, dim, norm``: components as ``floor(scale * x)`` in little-endian bytes.

    Two bytes a component, eight where the row does not fit (``wide``).  Rows with a
    null id, label or vector, or any null or non-finite component, are left out; so
    are further copies of a row that agree in id, label and vector.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            parts = lists.values.slice(starts[0], starts[-1] - starts[0])
            starts = starts - starts[0]
            x = parts.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.floor(scale * x)
            sizes = np.diff(starts)
            row = np.repeat(np.arange(len(sizes)), sizes)
            spoilt = np.bincount(row[~np.isfinite(q)], minlength=len(sizes)) > 0
            usable = ~spoilt & np.asarray(lists.is_valid())
            q = np.where(np.isfinite(q), q, 0)
            big = np.bincount(row[np.abs(q) > 32767], minlength=len(sizes)) > 0
            norm = np.bincount(row, weights=q * q, minlength=len(sizes))
            for wide, kind in ((False, "<i2"), (True, "<i8")):
                chosen = usable & (big == wide)
                if not chosen.any():
                    continue
                data = np.clip(q[chosen[row]], -(2.0**62), 2.0**62).astype(kind).tobytes()
                ends = np.concatenate([[0], np.cumsum(sizes[chosen])]) * np.dtype(kind).itemsize
                v = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), int(chosen.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
                ).cast(pa.binary())
                ids, labels = (batch[c].filter(pa.array(chosen)) for c in ("vec_id", "label"))
                flag = pa.array(np.full(len(ids), wide))
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, flag, v, pa.array(sizes[chosen].astype(np.int32)), pa.array(norm[chosen])],
                    names=["vec_id", "label", "wide", "v", "dim", "norm"],
                )

    plain = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding")
    kept = plain.dropna().mapInArrow(packed, _PACKED)
    return kept.dropDuplicates(["vec_id", "label", "wide", "v"])


class Residues:
    """Component matrices modulo several primes, and exact scores from their products.

    Residues lie around zero, so that the sum of ``SPAN`` products of two stays exact
    in float32; so many primes are taken that every score up to ``bound`` is told
    apart.  Scores come back by mixed-radix Chinese remaindering.
    """

    def __init__(self, bound: int, dim: int):
        self.span = max(1, min(dim, SPAN))
        self.dim = dim
        self.primes: list[int] = []
        p = 2 * isqrt(EXACT // self.span) + 1
        # Digits stay within half a prime, up to one unit of rounding: twice the range is ample.
        while prod(self.primes) <= 4 * bound + 4:
            p = next(n for n in range(p - 1, 1, -1) if all(n % d for d in range(2, isqrt(n) + 1)))
            self.primes.append(p)
        self.inverse = {
            (i, j): np.float32(_middle(pow(self.primes[j], -1, self.primes[i]), self.primes[i]))
            for i in range(len(self.primes))
            for j in range(i)
        }

    def of(self, q: np.ndarray) -> list[np.ndarray]:
        """One float32 matrix for each prime."""
        out = []
        for p in self.primes:
            r = q % p
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Inner products of all rows of one side with all of the other, as int64."""
        digits: list[np.ndarray] = []
        for i, p in enumerate(self.primes):
            rest = np.zeros((len(a[i]), len(b[i])), np.float32)
            for k in range(0, self.dim, self.span):
                part = _centred(a[i][:, k : k + self.span] @ b[i][:, k : k + self.span].T, p)
                rest = part if self.dim <= self.span else _centred(rest + part, p)
            for j, digit in enumerate(digits):
                rest = _centred(_centred(rest - digit, p) * self.inverse[i, j], p)
            digits.append(rest)
        total = digits[-1].astype(np.int64)
        for digit, p in zip(digits[-2::-1], self.primes[-2::-1], strict=True):
            total = total * p + digit.astype(np.int64)
        return total


def _middle(x: int, p: int) -> int:
    return x - p if x > p // 2 else x


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    return x - np.rint(x * np.float32(1 / p)) * np.float32(p)


class Best:
    """The highest scores of each group so far, ties by smaller id."""

    def __init__(self, groups: int, k: int):
        self.score = np.full((groups, k), _NONE, np.int64)
        self.id = np.full((groups, k), np.iinfo(np.int64).max, np.int64)

    def offer(self, group: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        """Takes candidates in; those of one call may come in any order, later calls have larger ids."""
        better = score > self.score[group, -1]
        if not better.any():
            return
        group, score, other = group[better], score[better], other[better]
        touched, place = np.unique(group, return_inverse=True)
        k = self.score.shape[1]
        group = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
        score = np.concatenate([self.score[touched].ravel(), score])
        other = np.concatenate([self.id[touched].ravel(), other])
        order = np.lexsort((other, -score, group))
        group, score, other = group[order], score[order], other[order]
        first = np.searchsorted(group, np.arange(len(touched)))
        rank = np.arange(len(group)) - first[group]
        kept = rank < k
        self.score[touched[group[kept]], rank[kept]] = score[kept]
        self.id[touched[group[kept]], rank[kept]] = other[kept]


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Packed vectors as int64 rows; a shorter vector ends in zeros."""
    out = np.zeros((len(batch), dim), np.int64)
    wide = np.asarray(batch["wide"])
    for flag, kind in ((False, "<i2"), (True, "<i8")):
        rows = np.flatnonzero(wide == flag)
        parts = [np.frombuffer(v.as_buffer(), kind) for v in batch["v"].take(pa.array(rows))]
        for row, part in zip(rows, parts, strict=True):
            out[row, : len(part)] = part
    return out


class _Block:
    """Anchors of one cell, and the best rows seen for them."""

    def __init__(self, rows: list[pa.RecordBatch], residues: Residues, k: int, windows: tuple[int, int] | None):
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        self.residues, self.windows = residues, windows
        self.ids, self.labels, self.keys = (np.asarray(table[c]) for c in ("vec_id", "label", "key"))
        self.matrix = residues.of(_matrix(table, residues.dim))
        self.near = table["near"].to_pylist() if windows else [[None]] * len(self.ids)
        self.slots = max(map(len, self.near))
        self.best = Best(len(self.ids) * self.slots, k)
        if windows:
            scores = np.zeros((len(self.ids), self.slots), np.int64)
            self.low = np.full(scores.shape, np.iinfo(np.int64).max)
            self.high = np.full(scores.shape, np.iinfo(np.int64).min)
            for i, near in enumerate(self.near):
                for j, found in enumerate(near):
                    self.low[i, j] = -(-windows[0] * found["score"] // 100)
                    self.high[i, j] = windows[1] * found["score"] // 100

    def meet(self, batch: pa.RecordBatch) -> None:
        ids, labels = np.asarray(batch["vec_id"]), np.asarray(batch["label"])
        rows = self.residues.of(_matrix(batch, self.residues.dim))
        for a in range(0, len(self.ids), TILE[0]):
            span = slice(a, a + TILE[0])
            scores = self.residues.scores([m[span] for m in self.matrix], rows)
            last = self.best.score[:, -1].reshape(len(self.ids), self.slots)[span]
            same = self.labels[span, None] == labels[None, :]
            if self.windows is None:
                x, y = np.nonzero(same & (scores > last[:, :1]))
                x, y = self._others(x, y, a, ids)
                self.best.offer(x + a, scores[x, y], ids[y])
                continue
            floor = np.maximum(self.low[span], last + 1).min(axis=1)
            x, y = np.nonzero(~same & (scores >= floor[:, None]) & (scores <= self.high[span].max(axis=1)[:, None]))
            x, y = self._others(x, y, a, ids)
            s = scores[x, y]
            for j in range(self.slots):
                fit = (s >= self.low[x + a, j]) & (s <= self.high[x + a, j])
                self.best.offer((x[fit] + a) * self.slots + j, s[fit], ids[y[fit]])

    def _others(self, x, y, a, ids):
        other = self.ids[x + a] != ids[y]
        return x[other], y[other]

    def result(self) -> pa.RecordBatch:
        group, rank = np.nonzero(self.best.score > _NONE)
        anchor, slot = group // self.slots, group % self.slots
        known = [self.near[i][j] or {"id": None, "score": None} for i, j in zip(anchor, slot, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[anchor]),
                pa.array(self.keys[anchor]),
                pa.array(slot.astype(np.int32)),
                pa.array([n["id"] for n in known], pa.int64()),
                pa.array([n["score"] for n in known], pa.int64()),
                pa.array(self.best.id[group, rank]),
                pa.array(self.best.score[group, rank]),
            ],
            names=["anchor_id", "key", "slot", "positive_id", "positive_score", "other_id", "score"],
        )


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, stripes: int, k: int, bound: int, dim: int, windows) -> DataFrame:
    """Every anchor block with every stripe of rows, one cell a task: the best ``k`` of each.

    A cell's anchors come first and stay; its rows stream past in the order of their
    ids, so a task holds a block of anchors and some thousand rows.  No cell depends on
    labels or on how often a vector occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residues, waiting, block = Residues(bound, dim), [], None
        for batch in batches:
            first = int((np.asarray(batch["kind"]) == 0).sum())
            if first:
                waiting.append(batch.slice(0, first))
            if first == len(batch) or not waiting:
                continue
            block = block or _Block(waiting, residues, k, windows)
            for at in range(first, len(batch), TILE[1]):
                block.meet(batch.slice(at, TILE[1]))
        if block:
            yield block.result()

    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    columns = ("vec_id", "label", "key", "wide", "v")
    block_of = F.pmod(F.xxhash64("key"), F.lit(blocks)) * stripes
    left = anchors.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda j: block_of + j)).alias("cell"),
        F.lit(0).alias("kind"), *columns, (F.col("near") if windows else none).alias("near"),
    )
    stripe_of = F.pmod("key", F.lit(stripes))
    right = rows.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i * stripes + stripe_of)).alias("cell"),
        F.lit(1).alias("kind"), *columns, none.alias("near"),
    )
    cells = left.union(right).repartitionById(blocks * stripes, F.col("cell").cast("int"))
    return cells.sortWithinPartitions("kind", "vec_id").drop("cell").mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "key", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, embedding, label``; ``anchors`` is a condition on ``vec_id``
    and ``label``.  For each anchor the ``positives`` other rows of its label with the
    highest scores, and for each of these the ``negatives`` highest rows of other
    labels whose score is between ``window`` percent of the positive's.  Scores are
    inner products of ``floor(scale * x)``, higher first, ties by smaller id.

    Rows that take no part: see ``pack``.  A row is known by its id, so an anchor's
    other rows are those of other ids; rows that share an id but differ all take part.
    Vectors of unequal length are compared as if the shorter ended in zeros; an empty
    vector scores zero.  An anchor without positives, or a positive without negatives
    in its window (always so for a negative score), gives no rows, and an empty table
    gives none.  Scores of 2**55 or more raise an error.  Other columns are left out.

    All rows meet all anchors in cells of an anchor block and a stripe of rows, both
    dealt by a hash of the whole row; see ``_meet``.  Running best scores are kept in
    the task, so a cell sends on ``positives * negatives`` rows an anchor at most.
    """
    spark = rows.sparkSession
    use_checkpoints(spark)
    ready = pack(rows, scale).withColumn("key", F.xxhash64("vec_id", "label", "wide", "v")).checkpoint()
    chosen = ready.where(anchors)
    norm, dim = ready.agg(F.max("norm"), F.max("dim")).first()
    bound = int((norm or 0.0) * 1.0001) + 1
    if bound >= MOST:
        raise ValueError(f"scores may reach {bound}, beyond {MOST}: use a smaller scale")
    dim = dim or 0
    each = 4 * dim * len(Residues(bound, dim).primes) + 16 * positives * negatives + 64
    blocks = -(-chosen.count() // max(1, BLOCK_BYTES // each)) or 1
    stripes = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    near = _first(_meet(chosen, ready, blocks, stripes, positives, bound, dim, None), positives)
    near = near.groupBy("anchor_id", "key").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("other_id").alias("id"), "score"))).alias("near")
    )
    near = near.select(
        F.col("anchor_id").alias("vec_id"), "key",
        F.transform("near", lambda n: F.struct(n["id"].alias("id"), n["score"].alias("score"))).alias("near"),
    )
    asking = chosen.join(near, ["vec_id", "key"])
    found = _first(_meet(asking, ready, blocks, stripes, negatives, bound, dim, window), negatives)
    return found.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("other_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


ORACLE = """
WITH rows AS (
  SELECT vec_id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS bigint) AS label,
         [floor(256 * CAST(x AS double)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS bigint) AS score
  FROM (SELECT DISTINCT * FROM rows) a JOIN (SELECT DISTINCT * FROM rows) b
    ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.*, n.other_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
   AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS int) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
