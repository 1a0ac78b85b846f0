"""Invariants for array operators and the rows-only model queries."""

import json
import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import arrays as ar
from tests.conftest import SMOKE_DIR


def test_psnr_identical_is_inf_and_noise_is_clamped(spark):
    df = spark.createDataFrame([(1, [0.0, 0.5, 1.0, 0.25]), (2, [1.0, 1.0, 0.0, 0.0])], "id long, a array<double>")
    out = df.select("id", ar.psnr(ar.mse("a", "a")).alias("p"),
                    ar.corrupt("a", "id", 0.30, 0.15, 11).alias("n")).collect()
    assert all(math.isinf(r["p"]) and r["p"] > 0 for r in out)
    assert all(0.0 <= v <= 1.0 for r in out for v in r["n"])
    again = df.select(ar.corrupt("a", "id", 0.30, 0.15, 11).alias("n")).collect()
    assert [r["n"] for r in out] == [r["n"] for r in again]  # replayable noise


def test_image_view_flip_and_flatten(spark):
    df = spark.createDataFrame([(list(range(16)),)], "a array<int>")
    r = df.select(ar.as_image("a", 4, 4).alias("img")).select(
        "img", ar.hflip("img").alias("f"), ar.flatten_image("img").alias("flat")).first()
    assert r["img"][1] == [4, 5, 6, 7]
    assert r["f"][0] == [3, 2, 1, 0]
    assert r["flat"] == list(range(16))


def test_noise_moments_look_normal(spark):
    df = spark.range(2000).select(F.col("id"), F.array_repeat(F.lit(0.5), 64).alias("a"))
    vals = df.select(F.explode(ar.corrupt("a", "id", 0.10, 0.0, 5)).alias("v"))
    m = vals.agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
    assert abs(m["m"] - 0.5) < 0.005 and abs(m["s"] - 0.10) < 0.005


def test_model_queries_invariants(spark):
    q = entry.queries()
    imp = q["feature_importance"](spark, SMOKE_DIR).collect()
    assert math.isclose(sum(r["importance"] for r in imp), 1.0, rel_tol=1e-9)
    assert [r["importance"] for r in imp] == sorted((r["importance"] for r in imp), reverse=True)
    sweep = q["kmeans_sweep"](spark, SMOKE_DIR).collect()
    assert [r["k"] for r in sweep] == list(range(2, 9))
    best_k = min(sweep, key=lambda r: (-r["silhouette"], r["k"]))["k"]
    inertia = {r["k"]: r["inertia"] for r in sweep}
    assert all(inertia[k + 1] <= inertia[k] * 1.001 for k in range(2, 8))  # ten restarts leave no bad fit
    seg = q["customer_segments"](spark, SMOKE_DIR)
    assert {"segment", "kmeans_cluster", "dbscan_cluster", "label"} <= set(seg.columns)
    rows = seg.collect()
    assert len(rows) == spark.read.parquet(f"{SMOKE_DIR}/customer.parquet").count()
    assert {r["kmeans_cluster"] for r in rows} == set(range(best_k))
    profile = {r["cluster"]: r["n"] for r in q["kmeans_assign"](spark, SMOKE_DIR).collect()}
    assert profile == {k: sum(r["kmeans_cluster"] == k for r in rows) for k in profile}
    density = {r["cluster"]: r["n"] for r in q["dbscan_profile"](spark, SMOKE_DIR).collect()}
    assert density == {k: sum(r["dbscan_cluster"] == k for r in rows) for k in density}
    pca = q["pca_2d"](spark, SMOKE_DIR).collect()
    assert {r["c_custkey"]: r["kmeans_cluster"] for r in pca} == {r["c_custkey"]: r["kmeans_cluster"] for r in rows}
    rt = q["model_roundtrip"](spark, SMOKE_DIR).first()
    assert rt["n"] == rt["n_equal"] > 0
    cmp = q["model_comparison"](spark, SMOKE_DIR).collect()
    assert {r["model"] for r in cmp} == {"random_forest", "gradient_boosted_trees"}
    assert all(0.0 <= r["accuracy"] <= 1.0 and 0.0 <= r["roc_auc"] <= 1.0 for r in cmp)
    best = q["best_model"](spark, SMOKE_DIR).first()
    assert best["best_model"] == min(cmp, key=lambda r: (-r["roc_auc"], r["model"]))["model"]
    doc = json.loads(q["summary_json"](spark, SMOKE_DIR).first()["summary"])
    assert set(doc) == {"model_results", "best_model", "feature_importance", "best_k_kmeans", "kmeans_cluster_profile",
                        "dbscan_n_clusters", "dbscan_n_noise", "dbscan_cluster_profile"}
    assert doc["best_k_kmeans"] == best_k and doc["best_model"] == best["best_model"]
    assert sum(doc["kmeans_cluster_profile"]["n"].values()) == len(rows)


def test_grid_search_keeps_node_numbers_with_the_rows(spark):
    """Deep forests are not sent to the tasks of every level; the scores are those of a search that sends them."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor

    from tessera.operators import models as mo

    rows = [(float(i % 7), float(i * i % 11), float(i % 7 + i % 3), i % 3) for i in range(90)]
    data = mo.assemble(spark.createDataFrame(rows, "a double, b double, label double, fold int").coalesce(1), ["a", "b"])
    model, grid = mo.grid_search(data, "label", "fold", [3], [2, 8], [1], parallelism=2)
    assert model.bestModel.getCacheNodeIds()
    plain = RandomForestRegressor(seed=42, featureSubsetStrategy="all", numTrees=3, minInstancesPerNode=1)
    ev = RegressionEvaluator(metricName="r2")
    for params, score in zip(grid, model.avgMetrics):
        depth = next(v for k, v in params.items() if k.name == "maxDepth")
        each = [ev.evaluate(plain.copy({plain.maxDepth: depth}).fit(data.where(F.col("fold") != f)).transform(
            data.where(F.col("fold") == f))) for f in range(3)]
        assert math.isclose(score, sum(each) / 3, rel_tol=1e-12)


def test_training_rows_lie_in_a_partition_per_core(spark):
    """Many rows do not make more partitions than cores: each sends the statistics of all nodes."""
    from tessera.plans import modelsq as mq

    cores = spark.sparkContext.defaultParallelism
    laid_out = mq._training(spark.range(cores * 100_000).repartition(4 * cores))
    assert laid_out.rdd.getNumPartitions() == cores and laid_out.count() == cores * 100_000


def test_forest_classifier_keeps_node_numbers_within_a_bound(spark, monkeypatch):
    from tessera.operators import models as mo

    rows = [(float(i % 7), float(i * i % 11), float(i % 7 > 3)) for i in range(60)]
    data = mo.assemble(spark.createDataFrame(rows, "a double, b double, label double").coalesce(2), ["a", "b"])
    trees = {}
    for most in (1_000, 10):
        monkeypatch.setattr(mo, "KEPT_NODES", most)
        forest = mo.classifiers(42, 3, 2)["random_forest"]
        trees[most] = mo.fit_all({"random_forest": forest}, data)["random_forest"].toDebugString.split("\n", 1)[1]
        assert forest.getCacheNodeIds() == (most == 1_000)
    assert trees[1_000] == trees[10]


def test_estimators_of_many_rows_are_fitted_one_after_another(spark, monkeypatch):
    import threading
    import time

    from tessera.operators import models as mo

    class Slow:
        running, most, lock = 0, 0, threading.Lock()

        def fit(self, train):
            with Slow.lock:
                Slow.running += 1
                Slow.most = max(Slow.most, Slow.running)
            time.sleep(0.5)
            with Slow.lock:
                Slow.running -= 1
            return train.count()

    for bound, most in ((100, 2), (99, 1)):
        monkeypatch.setattr(mo, "TOGETHER_ROWS", bound)
        Slow.most = 0
        assert mo.fit_all({"a": Slow(), "b": Slow()}, spark.range(100)) == {"a": 100, "b": 100}
        assert Slow.most == most


def test_value_range_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "id long, a array<double>")
    lo, hi = ar.value_range(empty, "a")
    assert empty.limit(0).select(ar.to_pixels("a", lo, hi)).count() == 0 and (lo, hi) == (0.0, 0.0)
