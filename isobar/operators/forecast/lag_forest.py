"""Random forest on lags, rolling means and season, forecast step by step.

One forest serves all keys: it is trained on the pooled rows with the place of
each key as extra features, which spreads both training and forecasting over
the cluster whatever the size of a key.  A forest per key, grown elsewhere,
gives other trees and so other numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...schema import DEFAULT_KEYS, PLACE_COLUMNS
from ...storage import discard, shared_folder, shuffles_end, stored, use_checkpoints
from ..timeseries import LAGS, ROLLING, ml_feature_frame, ml_feature_names
from .common import Z95, extent, forecast_rows, tail_arrays, train_rows, with_steps
from .forest import Forest, Tree

# Trees and seed of the forest.
TREES = 100
SEED = 42
# Levels of a tree: a leaf of a full tree then holds one row of 65,536.
DEPTH = 16
# Rows of a leaf, at least: the usual choice for regression forests.
LEAF_ROWS = 5


# Statistics of nodes that every running task holds at once, and again while it sends
# them: four tasks of an executor must fit beside the rows and the trees.
NODE_MEMORY_MB = 128
# Trees whose nodes travel together.
GROUP = 25


class _Nodes:
    """The nodes of some trees, one entry each; the right child follows the left one.

    Thirteen bytes a node, and their number is bounded by the forest's settings, not
    by the data: at most ``trees * 2 ** (depth + 1)``.
    """

    def __init__(self, table: pd.DataFrame):
        order = _by_level(table)
        table = table.iloc[order].reset_index(drop=True)
        place = pd.Series(np.arange(len(table), dtype=np.int32), index=pd.MultiIndex.from_frame(table[["tree", "id"]]))
        inner = (table["left"] >= 0).to_numpy()
        self.roots = np.flatnonzero(table["id"].to_numpy() == 0).astype(np.int32)
        self.left = np.arange(len(table), dtype=np.int32)
        self.left[inner] = place.loc[pd.MultiIndex.from_frame(table.loc[inner, ["tree", "left"]])].to_numpy()
        # A leaf leads back to itself: no feature lies beyond its cut.
        self.feature = np.where(inner, table["feature"].to_numpy(), 0).astype(np.int8)
        self.cut = np.where(inner, table["cut"].astype(float), np.inf).astype(np.float32)
        self.value = table["prediction"].to_numpy(np.float32)

    @classmethod
    def grown(cls, trees: list[Tree], cuts: list[np.ndarray] | None) -> _Nodes:
        """The nodes of trees; without ``cuts`` they take the bins of rows instead of features."""
        self = cls.__new__(cls)
        sizes = [len(tree.left) for tree in trees]
        self.roots = np.append(0, np.cumsum(sizes[:-1])).astype(np.int32)
        self.left = np.concatenate([tree.left for tree in trees])
        self.feature = np.concatenate([tree.feature for tree in trees])
        bins, inner = np.concatenate([tree.bin for tree in trees]), self.left > 0
        if cuts is None:
            self.cut = np.where(inner, bins, 255).astype(np.uint8)
        else:
            # A cut follows each bin but the last, which no row is split by.
            table = np.full((len(cuts), 256), np.inf, dtype=np.float32)
            for of, known in zip(table, cuts, strict=True):
                of[: len(known)] = known
            self.cut = np.where(inner, table[self.feature, bins], np.float32(np.inf))
        self.value = np.concatenate([tree.value for tree in trees])
        if cuts is not None:
            self.value = self.value.astype(np.float32)
        self.left = np.where(inner, self.left + np.repeat(self.roots, sizes), np.arange(len(inner))).astype(np.int32)
        return self

    def total(self, rows: np.ndarray) -> np.ndarray:
        """Sum over the trees for each row of float32 features, or of bins."""
        each = np.arange(len(rows))[:, None]
        node = np.tile(self.roots, (len(rows), 1))
        while True:
            below = self.left[node] + (rows[each, self.feature[node]] > self.cut[node])
            if np.array_equal(below, node):
                return self.value[node].sum(axis=1, dtype=float)
            node = below


def _by_level(table: pd.DataFrame) -> np.ndarray:
    """An order in which the two children of a node are neighbours, left first."""
    inner = table[table["left"] >= 0]
    parent = pd.concat(
        [inner.assign(child=inner[side], place=i)[["tree", "child", "id", "place"]] for i, side in enumerate(("left", "right"))]
    ).rename(columns={"id": "parent", "child": "id"})
    placed = table[["tree", "id"]].merge(parent, on=["tree", "id"], how="left")
    return placed.fillna(-1).sort_values(["tree", "parent", "place"], kind="stable").index.to_numpy()


def _stored_nodes(spark: SparkSession, model: RandomForestRegressionModel, trees: int) -> list:
    """The nodes of a forest that spark.ml has fitted, a broadcast for each group of trees, by way of its stored form."""
    path = f"{shared_folder(spark).rstrip('/')}/isobar-forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    table = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        node["prediction"].alias("prediction"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"),
    )
    groups = [
        spark.sparkContext.broadcast(_Nodes(table.where(F.col("tree").between(t, t + GROUP - 1)).toPandas()))
        for t in range(0, trees, GROUP)
    ]
    discard(spark, path)
    return groups


def _broadcast(spark: SparkSession, forest: Forest, cuts: list[np.ndarray] | None) -> list:
    """The nodes of a grown forest, a broadcast for each group of trees."""
    return [
        spark.sparkContext.broadcast(_Nodes.grown(forest.read(t, min(t + GROUP, forest.trees)), cuts))
        for t in range(0, forest.trees, GROUP)
    ]


def _spread(forest: Forest, keys: Sequence[str]) -> DataFrame:
    """Per key the standard deviation of labels around the forest's predictions."""
    groups, trees, features = _broadcast(forest.rows.sparkSession, forest, None), forest.trees, len(forest.cuts)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label = np.frombuffer(batch.column("label")[i].as_py())
                rows = np.frombuffer(batch.column("bins")[i].as_py(), np.uint8).reshape(features, -1).T
                predicted = sum(nodes.value.total(rows) for nodes in groups) / trees
                found = [batch.column("keys")[i].values, pa.array(label - predicted)]
                yield pa.RecordBatch.from_arrays(found, ["keys", "residual"])

    known = forest.rows.select("keys", "label", "bins")
    shape = T.StructType([T.StructField("keys", known.schema["keys"].dataType.elementType), T.StructField("residual", T.DoubleType())])
    left = known.mapInArrow(residuals, shape).select("keys.*", "residual")
    spread = stored(left.groupBy(*keys).agg(F.stddev_pop("residual").alias("residual_std")), "forest-spread")
    for nodes in groups:
        nodes.destroy()
    return spread


def _features(past: np.ndarray, days: pd.DatetimeIndex, places: np.ndarray) -> np.ndarray:
    """Features of one day per key from the latest values, 0.0 where out of reach."""
    angle = 2 * np.pi * days.dayofyear.to_numpy() / 365.25
    lags = [past[:, -k] for k in LAGS]
    rolling = [past[:, -k:].sum(axis=1) / k for k in ROLLING]
    known = np.nan_to_num(np.stack([*lags, *rolling], axis=1))
    season = np.stack([days.month.to_numpy(float), np.sin(angle), np.cos(angle)], axis=1)
    return np.concatenate((season, known, places), axis=1).astype(np.float32)


def forecast_lag_forest(
    split: DataFrame,
    forecast_days: int = 90,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
    trees: int = TREES,
    depth: int = DEPTH,
    traits: Sequence[str] = PLACE_COLUMNS,
) -> DataFrame:
    """Recursive forest forecast with a constant residual band.

    Training runs when this is called.  Forecasting is one pass over one row per
    key: each step predicts a day for all keys of a batch at once from the trees'
    node arrays.  ``trees`` and ``depth`` are settings of the model; ``traits`` names
    the numbers, one per key, that tell keys apart, where ``split`` has them.
    """
    use_checkpoints(split.sparkSession)
    train = train_rows(split)
    places = [c for c in traits if c in split.columns]
    place = train.groupBy(*keys).agg(*[F.max(c).alias(c) for c in places]) if places else None

    def with_place(df: DataFrame) -> DataFrame:
        return df.join(place, list(keys)) if places else df

    names = [*ml_feature_names(), *places]
    assemble = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep")
    rows = with_place(ml_feature_frame(train, target, keys).dropna(subset=[target]))
    # The same rows in the same partitions and order each time: bagging draws by
    # position, so this makes the forest repeatable.  The time in the hash also
    # spreads a hot key.
    placed = rows.repartition(*keys, "time").sortWithinPartitions(*keys, "time")
    learned = assemble.transform(placed).select(*keys, target, "_features").checkpoint()
    forest = RandomForestRegressor(
        featuresCol="_features",
        labelCol=target,
        predictionCol="_predicted",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=LEAF_ROWS,
        seed=SEED,
        featureSubsetStrategy="all",
        # Nodes split in one pass over the rows; the trees do not depend on it.
        maxMemoryInMB=NODE_MEMORY_MB,
        # For a fit of spark.ml: rows remember their nodes.  Growing here does without.
        cacheNodeIds=True,
    )
    with shuffles_end(split.sparkSession):
        model = Forest(forest, learned, list(keys))
        spread = _spread(model, keys)
    groups = _broadcast(split.sparkSession, model, model.cuts)
    discard(split.sparkSession, f"{shared_folder(split.sparkSession).rstrip('/')}/{model.folder}")
    reach = max(*LAGS, *ROLLING)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def ahead(tail: pd.Series, last: pd.Series, steps: pd.Series, place: pd.Series) -> pd.Series:
        past = np.full((len(tail), reach), np.nan)
        for i, values in enumerate(tail):
            past[i, reach - len(values) :] = values
        fixed = np.vstack(place.to_numpy()).astype(float)
        start = pd.DatetimeIndex(last)
        found = []
        for step in range(1, int(steps.max()) + 1):
            rows = _features(past, start + pd.Timedelta(days=step), fixed)
            found.append(sum(nodes.value.total(rows) for nodes in groups) / trees)
            past = np.concatenate((past[:, 1:], found[-1][:, None]), axis=1)
        path = np.stack(found, axis=1)
        return pd.Series([p[:n] for p, n in zip(path, steps, strict=True)])

    history = train.select(*keys, "time", F.col(target).cast("double").alias("y"))
    ends = with_steps(extent(split, keys), forecast_days)
    state = with_place(
        ends.join(tail_arrays(history, ["y"], reach, keys), list(keys)).join(spread, list(keys))
    )
    known_places = F.array(*[F.col(c).cast("double") for c in places]) if places else F.array().cast("array<double>")
    solved = state.withColumn("predictions", ahead("tail_y", "last_time", "steps", known_places))
    return forecast_rows(solved, "random_forest", keys, "predictions", Z95 * F.col("residual_std"))
