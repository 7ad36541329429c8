"""Rule statistics of documents and an isolation forest over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import use_checkpoints
from .sampling import smallest
from .texts import SPACES, Words, byte_column, chunks, mixed, range_hashes, spare, sums_by_text, windows

#: Labelled rows, at most, that the forest is fitted on.  Its threshold comes from all of them.
SAMPLE = 8_192
TREES = 200
TREE_ROWS = 256
#: The part of well labelled rows that the threshold must leave.
KEPT_GOOD = 0.995
EDGE = 0.001
#: Scores are counted in so many steps to find the threshold.
STEPS = 1 << 16

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_distinct")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "distinct")


def _of_chunk(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    texts = len(offsets) - 1
    inside = ~SPACES[data]
    words = Words(data, offsets, inside)
    n_words = words.counts()
    spread = mixed(np.arange(1, texts + 1, dtype=np.uint64))

    # Lines end at a line feed or at the end of their text.
    stops = np.unique(np.concatenate((np.flatnonzero(data == 10), offsets[1:] - 1)))
    stops = stops[stops >= 0]
    starts = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    ends = stops + (data[stops] != 10)
    with_word = np.concatenate(([0], np.cumsum(inside)))
    used = with_word[ends] > with_word[starts]
    starts, ends = starts[used], ends[used]
    home = np.searchsorted(offsets, starts, side="right") - 1
    keys = mixed(range_hashes(data, starts, ends) ^ spread[home])
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False

    hashes = words.hashes(data)
    runs = windows(hashes, 3)
    whole = words.text[: len(runs)] == words.text[2:] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    _, which, often = np.unique(runs[at] ^ spread[words.text[at]], return_inverse=True, return_counts=True)
    at = at[often[which] > 1]
    marked = np.zeros(len(words), bool)
    for i in range(3):
        marked[at + i] = True
    first = np.unique(hashes ^ spread[words.text], return_index=True)[1]

    count = lambda rows: np.bincount(rows, minlength=texts)
    return [
        n_words,
        sums_by_text(inside & ((data & 0xC0) != 0x80), offsets),
        sums_by_text(_SYMBOLS[data], offsets),
        count(home[again]),
        count(words.text[marked]),
        count(home),
        sums_by_text(_UPPER[data], offsets),
        count(words.text[first]),
    ]


def rule_statistics(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The ``keep`` columns and the statistics of every whole text; null has no words."""
    names = (*STATISTICS, *_MORE)
    hidden = spare(keep)
    kept = docs.select(*keep, F.col(text).alias(hidden))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name != hidden)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(hidden))
            parts = [
                _of_chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for i, j in chunks(offsets)
            ]
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(c.astype(np.int64)) for c in columns)], names=[*keep, *names]
            )

    return kept.mapInArrow(each, schema + ", ".join(f"{n} bigint" for n in names))


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as ratios, one row per document."""
    words, lines = np.maximum(columns["n_words"], 1), np.maximum(columns["n_lines"], 1)
    return np.stack(
        [
            columns["word_chars"] / words,
            columns["n_symbols"] / words,
            columns["n_dup_lines"] / lines,
            columns["n_repeat_words"] / words,
            columns["n_upper"] / np.maximum(columns["word_chars"], 1),
            columns["n_distinct"] / np.sqrt(words),
        ],
        axis=1,
    )


def margins(rows: np.ndarray, usual: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How far each ratio is outside the usual range, in widths of that range; 0 inside.

    Splits then tell unusual documents apart and leave the usual ones together.
    """
    low, high = usual
    return (np.maximum(0, rows - high) + np.maximum(0, low - rows)) / np.where(high > low, high - low, 1)


def usual_range(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of each ratio among well labelled rows, without the outer thousandth at either end."""
    return np.quantile(good, EDGE, axis=0, method="lower"), np.quantile(good, 1 - EDGE, axis=0, method="higher")


@dataclass
class Forest:
    """Isolation trees as arrays of nodes; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    usual: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: rows that few splits set apart come near 1."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int32)
            for _ in range(self.depth):
                low = rows[each, self.feature[t][node]] < self.cut[t][node]
                node = np.where(low, self.left[t][node], self.right[t][node])
            total += self.path[t][node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def _usual_path(n: int) -> float:
    """Mean path of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """Trees of random splits, each over its own draw of the rows."""
    rng = np.random.default_rng(seed)
    tree_rows = min(tree_rows, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(2, tree_rows)))))
    size = 2 ** (depth + 1) - 1
    shape = (trees, size)
    forest = Forest(
        np.zeros(shape, np.int16), np.zeros(shape), *(np.tile(np.arange(size, dtype=np.int32), (trees, 1)) for _ in range(2)),
        np.zeros(shape), depth, max(_usual_path(tree_rows), 1e-9),
    )
    for t in range(trees):
        todo = [(0, 0, rows[rng.choice(len(rows), tree_rows, replace=False)])]
        free = 1
        while todo:
            node, level, own = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level == depth or len(wide) == 0:
                forest.path[t, node] = level + _usual_path(len(own))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(low[f], high[f])
            below = own[:, f] < cut
            if below.all() or not below.any():
                cut = high[f]
                below = own[:, f] < cut
            forest.feature[t, node], forest.cut[t, node] = f, cut
            forest.left[t, node], forest.right[t, node] = free, free + 1
            todo += [(free, level + 1, own[below]), (free + 1, level + 1, own[~below])]
            free += 2
    return forest


def calibrate(
    scores: np.ndarray, good: np.ndarray, kept_good: float = KEPT_GOOD, times: np.ndarray | None = None
) -> float:
    """Threshold above which a document goes; ``times`` says how many rows a score stands for.

    Of all thresholds that leave ``kept_good`` of the good rows, the one that sets
    apart the most bad rows, and among those the highest.  Without rows of both kinds nothing goes.
    """
    if good.all() or not good.any():
        return float("inf")
    times = np.ones(len(scores), np.int64) if times is None else times
    order = np.argsort(scores[good], kind="stable")
    upto = np.cumsum(times[good][order])
    border = scores[good][order][np.searchsorted(upto, np.ceil(kept_good * (upto[-1] - 1)), side="right")]
    above = scores[~good][scores[~good] > border]
    # Half way to the nearest bad row, so that good rows near the border stay.
    return float((border + above.min()) / 2) if len(above) else float("inf")


def threshold_of(scored: DataFrame) -> float:
    """:func:`calibrate` over all rows of ``anomaly``, ``good`` and ``rows``, whatever their number.

    Scores are added up in ``STEPS`` steps.  A step stands at the highest good score in
    it, and at the lowest and the highest bad one.
    """
    step = F.floor(F.col("anomaly") * STEPS).alias("step")
    counted = scored.groupBy(step, "good").agg(
        F.min("anomaly").alias("low"), F.max("anomaly").alias("high"), F.sum("rows").alias("rows")
    )
    steps = counted.collect()
    found = [(r.high, r.good, r.rows) for r in steps] + [(r.low, False, r.rows) for r in steps if not r.good]
    if not found:
        return float("inf")
    scores, good, times = (np.array(x) for x in zip(*found, strict=True))
    return calibrate(scores, good, times=times)


def anomalies(rows: DataFrame, forest: Forest | None, usual: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``rows`` of rule statistics with their ``anomaly``, 0 without a forest."""
    columns = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = features({c: batch.column(c).to_numpy() for c in (*STATISTICS, *_MORE)})
            anomaly = forest.score(margins(ratios, usual)) if forest is not None else np.zeros(len(ratios))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly)], names=[*columns, "anomaly"])

    return rows.mapInArrow(each, StructType([*rows.schema.fields, StructField("anomaly", DoubleType())]))


def _base_failed():
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the rule statistics, ``base_failed``, ``anomaly`` and ``kept`` of every row.

    Statistics cover every whole text and are stored once.  The forest and the usual
    range of the ratios are fitted on at most ``sample`` different labelled rows that pass
    the base rules, those of the smallest id hash; the threshold comes from all labelled
    rows that pass them.  A document labelled more than once is good if most labels say
    so.  Rows with a null or unlabelled id are judged too; without labels of both kinds,
    only the base rules decide.  Repeated rows stay.  An empty table gives an empty one;
    a text of any length is gone over about a megabyte at a time.
    """
    use_checkpoints(docs.sparkSession)
    found = rule_statistics(docs, "text", "doc_id").checkpoint()
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).alias("good")
    )
    measured = ["doc_id", *STATISTICS, *_MORE]
    labelled = (
        found.where(~_base_failed())
        .groupBy(*measured)
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(marks, "doc_id")
        .withColumn("mark", F.xxhash64("doc_id"))
        .checkpoint()
    )
    first = F.shiftrightunsigned("mark", 1)
    drawn = smallest(labelled, "mark", sample).orderBy(first, *measured).limit(sample).collect()
    forest, usual, threshold = None, None, float("inf")
    good = np.array([r.good for r in drawn], bool)
    if good.any():
        rows = features({c: np.array([r[c] for r in drawn]) for c in (*STATISTICS, *_MORE)})
        usual = usual_range(rows[good])
        forest = grow(margins(rows, usual))
        threshold = threshold_of(anomalies(labelled, forest, usual))
    return anomalies(found, forest, usual).select(
        "doc_id", *STATISTICS, _base_failed().alias("base_failed"), "anomaly",
        (~_base_failed() & (F.col("anomaly") <= threshold)).alias("kept"),
    )
