"""Boosted trees: MLlib's trees where nothing is drawn, few partitions, and models that can be stored."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tessera.operators import boosting as bo
from tessera.operators import models as mo


@pytest.fixture(autouse=True)
def own_learner(monkeypatch):
    monkeypatch.setattr(bo, "FEW_ROWS", 0)


def _rows(spark, n=900):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = 3 * x[:, 0] + np.sin(3 * x[:, 1]) * x[:, 2] + rng.normal(size=n)
    rows = [(*map(float, r), float(v), float(v > 0.5), 0.5 + i % 3, i) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, y double, weight double, id long")
    return mo.assemble(df, ["a", "b", "c"]).repartition(3, "id").cache()


def test_regression_equals_mllib(spark):
    df = _rows(spark)
    own = mo.regressors(42, 2, 5)["gradient_boosting"].fit(df)
    other = GBTRegressor(maxIter=5, maxDepth=3, seed=42).fit(df)
    met = own.transform(df).select("id", "prediction").join(
        other.transform(df).select("id", F.col("prediction").alias("p")), "id").collect()
    assert len(met) == 900 and all(math.isclose(r["prediction"], r["p"], rel_tol=1e-9, abs_tol=1e-9) for r in met)
    assert np.allclose(own.featureImportances.toArray(), other.featureImportances.toArray())


def test_weighted_classes_equal_mllib_across_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(bo, "CHECKPOINT_EVERY", 4)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 100)
    df = _rows(spark)
    own = bo.BoostedTrees(classes=True, labelCol="y", weightCol="weight", maxIter=6, maxDepth=3, stepSize=0.05).fit(df)
    other = GBTClassifier(labelCol="y", weightCol="weight", maxIter=6, maxDepth=3, stepSize=0.05).fit(df)
    met = own.transform(df).select("id", "prediction", vector_to_array("probability")[1].alias("p1")).join(
        other.transform(df).select("id", F.col("prediction").alias("p"), vector_to_array("probability")[1].alias("q1")), "id").collect()
    assert all(r["prediction"] == r["p"] and math.isclose(r["p1"], r["q1"], rel_tol=1e-9) for r in met)


def test_drawn_rows_and_features_learn_and_are_replayed(spark):
    df = _rows(spark)
    model = mo.classifiers(7, 2, 12, "weight", "y")["gradient_boosted_trees"]
    first, again = model.fit(df), model.fit(df)
    assert first.getOrDefault("fitted") == again.getOrDefault("fitted")
    assert first.transform(df).where(F.col("prediction") == F.col("y")).count() > 750


def test_blocks_lie_in_a_partition_per_core_and_bounds_come_from_a_bounded_sample(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    seen = []
    found = bo.BoostedTrees._histograms
    monkeypatch.setattr(bo.BoostedTrees, "_histograms", lambda self, blocks, *a: seen.append(blocks.getNumPartitions()) or found(self, blocks, *a))
    monkeypatch.setattr(bo, "BIN_ROWS", 1)
    rows = spark.range(20_000).select((F.col("id") % 97).cast("double").alias("a"), F.col("id").cast("double").alias("b"),
                                      ((F.col("id") % 97) > 50).cast("double").alias("label")).repartition(5 * cores)
    model = mo.regressors(42, 2, 2)["gradient_boosting"].fit(mo.assemble(rows, ["a", "b"]))
    assert set(seen) == {cores}
    assert model.featureImportances[0] > 0.9


def test_constant_labels_and_few_rows(spark, monkeypatch):
    df = mo.assemble(spark.createDataFrame([(1.0, 2.0)] * 3, "a double, label double"), ["a"])
    learner = mo.regressors(42, 2, 3)["gradient_boosting"]
    assert {r["prediction"] for r in learner.fit(df).transform(df).collect()} == {2.0}
    monkeypatch.setattr(bo, "FEW_ROWS", 3)
    assert type(learner.fit(df)).__name__ == "GBTRegressionModel"


def test_saved_with_its_feature_step_and_loaded_again(spark, tmp_path):
    df = _rows(spark)
    pipe = PipelineModel(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"),
                                 mo.classifiers(7, 2, 2, None, "y")["gradient_boosted_trees"].fit(df)])
    loaded = mo.save_and_reload(pipe, f"file://{tmp_path}/model")
    got = [m.transform(df.drop("features")).select("id", "prediction", "probability").orderBy("id").collect() for m in (pipe, loaded)]
    assert got[0] == got[1]


def test_a_grid_search_holds_a_bounded_number_of_nodes(spark, monkeypatch):
    """Large forests are fitted in parts; the score is that of the mean of the parts' predictions."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor

    rows = [(float(i % 7), float(i * i % 11), float(i % 7 + i % 3), i % 3, i) for i in range(90)]
    data = mo.assemble(spark.createDataFrame(rows, "a double, b double, label double, fold int, id int").coalesce(1), ["a", "b"])
    fitted, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df, *a: fitted.append(self.getNumTrees()) or fit(self, df, *a))
    monkeypatch.setattr(mo, "NODES_AT_ONCE", 64)  # two trees of depth 2 a fit (four fits at once)
    monkeypatch.setattr(mo, "PART_ROWS", 1_000)
    model, grid = mo.grid_search(data, "label", "fold", [3], [2], [1, 2], parallelism=8)
    assert fitted == [2, 1] * 6 or sorted(fitted) == [1] * 6 + [2] * 6
    plain = RandomForestRegressor(maxDepth=2, featureSubsetStrategy="all")
    ev, scores = RegressionEvaluator(metricName="r2"), []
    for f in range(3):
        held = data.where(F.col("fold") == f)
        for n, seed in ((2, 42), (1, 43)):
            m = plain.copy({plain.numTrees: n, plain.seed: seed}).fit(data.where(F.col("fold") != f))
            held = m.transform(held).withColumnRenamed("prediction", f"p{n}")
        scores.append(ev.evaluate(held.withColumn("prediction", (2 * F.col("p2") + F.col("p1")) / 3)))
    assert math.isclose(model.avgMetrics[0], sum(scores) / 3, rel_tol=1e-12)
    assert len(model.avgMetrics) == len(grid) == 2
    assert model.transform(data).where(F.col("prediction").isNull()).count() == 0
