"""SimHash fingerprints linked within a Hamming radius by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import use_checkpoints
from .graph import components
from .texts import byte_column, spare

RADIUS = 4
SHINGLE = 4
#: The 64 bits fall into this many blocks.  Two fingerprints within the radius
#: agree on all but RADIUS of them, so on at least BLOCKS - RADIUS.
BLOCKS = 6
#: Fingerprints of a bucket that meet in one comparison, on average, at most twice.
CELL = 512

_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit fingerprint of a UTF-8 text.

    A bit is set if it is set in over half the hashes of the word shingles, repeats
    included.  Fewer words than a shingle make one; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=False)
    hashes = np.fromiter((digest(line[s:e], 42) for s, e in pairs), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        part = np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << _BITS[2 * ones > n]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The ``keep`` columns and ``fp`` (the fingerprint as a signed long) of every row."""
    hidden = spare(keep)
    kept = docs.select(*keep, F.col(text).alias(hidden))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name != hidden)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = byte_column(batch.column(hidden))
            found = [fingerprint(data[s:e].tobytes()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=[*keep, "fp"])

    return kept.mapInArrow(each, schema + "fp bigint")


def _bucket_keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key for each choice of blocks on which a pair within the radius may agree."""
    width, more = divmod(64, blocks)
    cuts = np.cumsum([0] + [width + (i < more) for i in range(blocks)]).tolist()
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key, bits = F.lit(n).cast("bigint"), 0
        for b in chosen:
            size = cuts[b + 1] - cuts[b]
            part = F.shiftrightunsigned(fp, cuts[b]).bitwiseAND(F.lit((1 << size) - 1))
            key, bits = F.shiftleft(key, size).bitwiseOR(part), bits + size
        keys.append(key)
    return F.array(*keys)


def near_pairs(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, within each run of ``fps``, of fingerprints at most ``radius`` bits apart.

    The bits are stored vertically: plane ``k`` holds bit ``k`` of 64 fingerprints in
    a word.  The planes, moved by ``d`` places, are compared with themselves, so a
    word compares 64 pairs at once.  Three planes at a time go through a carry-save
    adder into bitwise counters; a step ends early once every pair is beyond the
    radius.  Fingerprints whose run is no longer than ``d`` leave the planes.
    """
    run = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    left = np.diff(ends)[run] - (np.arange(len(fps)) - ends[:-1][run])
    at = np.arange(len(fps))
    longest = int(left.max(initial=0))
    d = 1
    planes = None
    while d < longest:
        in_use = np.diff(ends)[run[at]] > d
        if planes is None or in_use.sum() < 0.7 * len(at):
            at = at[in_use]
            planes = _planes(fps[at])
        yield from _step(planes, at, left, d, radius)
        d += 1


def _planes(fps: np.ndarray) -> np.ndarray:
    lanes = -(-len(fps) // 64) * 64 + 64
    bits = np.zeros((64, lanes), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _step(planes: np.ndarray, at: np.ndarray, left: np.ndarray, d: int, radius: int):
    if d >= len(at):
        return
    words, bits = divmod(d, 64)
    moved = np.zeros_like(planes)
    n = planes.shape[1] - words
    moved[:, :n] = planes[:, words:] >> np.uint64(bits)
    if bits:
        moved[:, : n - 1] |= planes[:, words + 1 :] << np.uint64(64 - bits)
    # A pair counts if both are in one run.  Those of a shorter run stay in the
    # planes for a while, so places differ by d in the planes and in the run.
    valid = np.zeros(planes.shape[1] * 64, np.uint8)
    valid[: len(at)] = left[at] > d
    alive = np.packbits(valid, bitorder="little").view(np.uint64)
    use = np.flatnonzero(alive)
    if not len(use):
        return
    differ, alive = planes[:, use] ^ moved[:, use], alive[use]
    depth = max(3, int(radius).bit_length() + 1)
    counters = np.zeros((depth, len(use)), np.uint64)
    beyond = np.zeros(len(use), np.uint64)
    for k in range(0, 64, 3):
        a, b, c = (differ[i] if i < 64 else np.uint64(0) for i in (k, k + 1, k + 2))
        half = a ^ b
        _add(counters, beyond, half ^ c, 0)
        _add(counters, beyond, (a & b) | (half & c), 1)
        if k % 12 == 9:
            beyond |= _over(counters, radius)
            if not (alive & ~beyond).any():
                return
    near = alive & ~(beyond | _over(counters, radius))
    lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(lanes)
    first = use[word] * 64 + bit
    yield at[first], at[first] + d


def _add(counters: np.ndarray, beyond: np.ndarray, carry: np.ndarray, level: int) -> None:
    for i in range(level, len(counters)):
        counters[i], carry = counters[i] ^ carry, counters[i] & carry
    beyond |= carry


def _over(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over the radius."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same &= counters[i]
        else:
            more |= same & counters[i]
            same &= ~counters[i]
    return more


def _stars(radius: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            fps = lists.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            root = np.arange(len(fps))

            def find(x: int, root: np.ndarray = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return int(x)

            for a, b in near_pairs(fps.view(np.uint64), ends, radius):
                apart = root[a] != root[b]
                for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                    x, y = find(x), find(y)
                    root[max(x, y)] = min(x, y)
                while not np.array_equal(root, root[root]):
                    root = root[root]
            out = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[out]), pa.array(fps[root[out]])], names=["a", "b"]
            )

    return each


def links(
    distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL
) -> DataFrame:
    """``a, b`` edges that connect the same fingerprints as all pairs within the radius do.

    ``distinct`` has one row per ``fp``.  A bucket holds the fingerprints that agree on
    some blocks.  A bucket of more than ``cell`` is cut into parts, and every two
    parts meet in a cell of their own, so nothing is left out and no task holds a
    bucket.  Every pair of a cell is compared; the pairs found leave it as a forest.
    """
    keyed = distinct.select("fp", F.explode(_bucket_keys(F.col("fp"), blocks, radius)).alias("key"))
    many = keyed.groupBy("key").count().where("count > 1")
    parts = F.ceil(F.col("count") / cell).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (
        keyed.join(many, "key")
        .select("key", "fp", parts.alias("parts"))
        .select("key", "fp", own.alias("own"), F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
        .select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .repartition("key", "i", "j")
        .groupBy("key", "i", "j")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .where(F.size("fps") > 1)
    )
    return cells.select("fps").mapInArrow(_stars(radius), "a bigint, b bigint")


def _grouped(docs: DataFrame, radius: int, *keep: str) -> tuple[DataFrame, DataFrame]:
    """The ``keep`` columns and ``fp`` of every row, and the ``root`` of every ``fp``."""
    use_checkpoints(docs.sparkSession)
    rows = fingerprints(docs, "text", *keep).checkpoint()
    distinct = rows.select("fp").distinct()
    reached = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    return rows, distinct.join(reached, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    The component is the smallest ``doc_id`` that links of at most ``radius``
    differing bits reach.  A null text counts as empty, and all texts without words
    have fingerprint 0 and are linked like others.  Rows with a null ``doc_id`` take
    part; the component is null only if no linked row has an id.  Repeated rows stay.
    Other columns are ignored.
    """
    rows, roots = _grouped(docs, radius, "doc_id")
    # Ids are counted down per fingerprint first: many rows may share one.
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = roots.join(first, "fp")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of :func:`near_duplicates`: that of the smallest ``doc_id``, columns unchanged.

    A null id comes last.  Among rows of one id, the smallest hash of all columns
    decides; of equal rows one stays.  An empty table stays empty.  Long texts are read
    whole; columns may have any names.
    """
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    marked = plain.select("*", doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(*plain.columns).alias("row"))
    rows, roots = _grouped(marked.select("doc_id", "row", "text"), radius, "doc_id", "row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    by_print = rows.groupBy("fp").agg(F.min(order).alias("o"))
    chosen = by_print.join(roots, "fp").groupBy("root").agg(F.min("o").alias("o"))
    chosen = chosen.select(F.col("o.doc_id").alias("kept_id"), F.col("o.row").alias("kept_row"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row"))
    one = marked.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "row"])
    return one.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
