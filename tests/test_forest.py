"""Trees grown where their rows are, against those of spark.ml."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from conftest import seasonal_series, to_pandas, to_spark
from isobar.operators.forecast import forest, lag_forest
from isobar.operators.timeseries import train_test_split
from isobar.storage import use_checkpoints

TREES = 27


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(size=(2500, 4)), columns=list("abcd"))
    frame["d"] = rng.integers(0, 3, 2500).astype(float)
    frame["y"] = frame.a * 3 + (frame.b > 0) * 5 + frame.d + rng.normal(size=2500)
    frame["key"] = np.arange(2500) // 900
    use_checkpoints(spark)
    table = spark.createDataFrame(frame).withColumn("key", F.expr("nullif(key, 1)"))
    return VectorAssembler(inputCols=list("abcd"), outputCol="x").transform(table).coalesce(1).checkpoint()


@pytest.fixture(scope="module")
def settings():
    return RandomForestRegressor(
        featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=9, minInstancesPerNode=5, seed=42, featureSubsetStrategy="all"
    )


@pytest.fixture(scope="module")
def model(rows, settings):
    return settings.fit(rows)


@pytest.mark.parametrize("draws", [1 << 20, 400])
def test_trees_are_those_of_spark_ml(spark, rows, settings, model, monkeypatch, draws):
    """F1 to F3: in one task from the root on, or from nodes that statistics have split."""
    monkeypatch.setattr(forest, "TASK_DRAWS", draws)
    monkeypatch.setattr(forest, "TRAVEL_BYTES", 1 << 20)
    grown = forest.Forest(settings, rows, ["key"])
    assert sum(len(tree.left) for tree in grown.read(0, TREES)) == model.totalNumNodes
    x = np.vstack(rows.select("x").toPandas()["x"].map(lambda v: v.toArray())).astype(np.float32)
    ours, theirs = (
        sum(g.value.total(x) for g in groups) / TREES
        for groups in (lag_forest._broadcast(spark, grown, grown.cuts), lag_forest._stored_nodes(spark, model, TREES))
    )
    np.testing.assert_allclose(ours, theirs, rtol=1e-6)
    spread = {r.key: r.residual_std for r in lag_forest._spread(grown, ["key"]).collect()}
    told = model.transform(rows).groupBy("key").agg(F.stddev_pop(F.col("y") - F.col("prediction")).alias("s")).collect()
    assert spread == {r.key: pytest.approx(r.s) for r in told} and None in spread


def test_spark_ml_makes_no_pass_for_every_few_nodes(spark, monkeypatch):
    """F1 to F3: a fit of spark.ml passes over all rows for as many nodes as its statistics hold."""

    def fit(self, rows):
        raise AssertionError("spark.ml fits the forest")

    monkeypatch.setattr(RandomForestRegressor, "fit", fit)
    parts = train_test_split(to_spark(spark, seasonal_series([90, 400])))
    got = to_pandas(lag_forest.forecast_lag_forest(parts, 5, "v", trees=7))
    assert got.groupby("station_id").size().to_dict() == {1: 30, 2: 30} and got["forecast"].notna().all()


def test_trees_without_draws_predict_zero_as_in_spark_ml(spark, settings):
    """Of four rows some trees draw none."""
    frame = pd.DataFrame({"a": [1.0, 2, 3, 4], "y": [5.0, 6, 7, 8], "key": 1})
    few = VectorAssembler(inputCols=["a"], outputCol="x").transform(spark.createDataFrame(frame)).coalesce(1)
    use_checkpoints(spark)
    few = few.checkpoint()
    told: RandomForestRegressionModel = settings.copy({settings.numTrees: 200}).fit(few)
    grown = forest.Forest(settings.copy({settings.numTrees: 200}), few, ["key"])
    ours = [tree.value[0] for tree in grown.read(0, 200)]
    theirs = [tree._call_java("rootNode").prediction() for tree in told.trees]
    np.testing.assert_allclose(ours, theirs)
    assert 0.0 in ours


def test_sums_of_the_larger_child_are_a_difference(monkeypatch):
    rng = np.random.default_rng(7)
    binned = rng.integers(0, 32, (6, 4000)).astype(np.uint8)
    label, weight = binned[0] * 0.5 + np.sin(binned[1]) + rng.normal(size=4000), rng.integers(1, 4, 4000).astype(np.uint8)
    plain = forest.grow_tree(label, weight, binned, 5, 5, 32)
    taken, sums = [], forest._Rows.sums
    monkeypatch.setattr(forest._Rows, "sums", lambda self, rows, sizes: taken.append(len(rows)) or sums(self, rows, sizes))
    monkeypatch.setattr(forest, "LARGE", 200)
    apart = forest.grow_tree(label, weight, binned, 5, 5, 32)
    for name in ("left", "feature", "bin"):
        np.testing.assert_array_equal(getattr(plain, name), getattr(apart, name))
    np.testing.assert_allclose(plain.value, apart.value)
    assert max(taken) <= 4000 and taken.count(4000) == 1


def test_runs_of_nodes(monkeypatch):
    monkeypatch.setattr(forest, "STEP_ROWS", 10)
    monkeypatch.setattr(forest, "STEP_NODES", 3)
    sizes = np.array([4, 4, 4, 30, 1, 1, 1, 1, 5, 5])
    assert list(forest._steps(sizes, {})) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 9), (9, 10)]
    assert list(forest._steps(sizes, {1: None, 5: None})) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 9), (9, 10)]
