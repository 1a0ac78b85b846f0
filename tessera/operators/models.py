"""Supervised models, clustering and projections on MLlib.

Callers assemble training frames once and checkpoint them into the shared
folder (iterative learners rescan their input many times; the checkpoint
cuts the lineage so a lost executor recomputes from it, not from the scans).
Evaluation reuses the exact aggregates of ``operators.metrics``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as me
from tessera.operators.boosting import BoostedTrees
from tessera.session import cut_lineage


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def regressors(seed: int = 42, trees: int = 100, boost_rounds: int = 100, label: str = "label") -> dict:
    """Linear, forest and boosted regressors (reference: 100 trees / 100 rounds)."""
    return {
        "linear_regression": LinearRegression(featuresCol="features", labelCol=label),
        "random_forest": RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees,
                                               featureSubsetStrategy="all", seed=seed),
        "gradient_boosting": BoostedTrees(classes=False, labelCol=label, maxIter=boost_rounds, maxDepth=3, seed=seed),
    }


#: Rows beyond which estimators are fitted one after another: together, what they keep would not fit the executors' memory.
TOGETHER_ROWS = 10_000_000
#: Node numbers (rows times trees) that a forest may keep with its rows; beyond, tasks find a row's node from the root.
KEPT_NODES = 1_500_000_000


def fit_all(estimators: dict, train: DataFrame) -> dict:
    """Fit independent estimators on the same rows, at the same time up to ``TOGETHER_ROWS``: their jobs share the executors."""
    from concurrent.futures import ThreadPoolExecutor

    n = train.count()
    for est in estimators.values():
        if isinstance(est, RandomForestClassifier):  # deep trees: the way from the root is half of the work
            est.setCacheNodeIds(n * est.getNumTrees() <= KEPT_NODES)
    if n > TOGETHER_ROWS:
        return {name: est.fit(train) for name, est in estimators.items()}
    with ThreadPoolExecutor(max_workers=len(estimators)) as pool:
        fits = {name: pool.submit(est.fit, train) for name, est in estimators.items()}
        return {name: f.result() for name, f in fits.items()}


def regression_compare(train: DataFrame, test: DataFrame, label: str, models: dict) -> DataFrame:
    """Fit each model on ``train``; (model, n, mae, rmse, r2) on ``test``."""
    rows = []
    for name, model in fit_all(models, train).items():
        pred = model.transform(test)
        rows.append(me.regression_metrics(pred, label, "prediction").select(F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, rows)


def classifiers(seed: int = 42, trees: int = 300, boost_rounds: int = 300, weight_col: str | None = None,
                label: str = "label") -> dict:
    """Forest (depth 10, class-weighted) and boosted trees (depth 5, rate 0.05, 0.8 subsampling)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=10, seed=seed)
    gbt = BoostedTrees(classes=True, labelCol=label, maxIter=boost_rounds, maxDepth=5, stepSize=0.05, subsamplingRate=0.8,
                       featureRate=0.8, weightCol=weight_col, seed=seed)
    if weight_col:
        rf.setWeightCol(weight_col)
    return {"random_forest": rf, "gradient_boosted_trees": gbt}


def classification_scores(pred: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """(metric, value) rows: accuracy, precision, recall, f1 (class 1) and exact ROC AUC."""
    scored = pred.withColumn("p1", vector_to_array("probability")[1])
    cm = me.class_metrics(scored, label, "prediction", 1.0, digits)
    auc = me.roc_auc(scored, label, "p1", 1, digits)
    long_cm = cm.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                                           for c in ("accuracy", "precision", "recall", "f1")])))
    return long_cm.unionByName(auc.select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value")))


def feature_importance(model, feature_cols: Sequence[str], spark) -> DataFrame:
    """(feature, importance) sorted descending (ties by name); importances sum to 1."""
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(feature_cols, imp), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def comparison_table(long_rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Model x metric table from (model, metric, value) rows (pivot on a fixed metric list)."""
    return long_rows.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


#: Tree nodes that a grid search may hold in the driver at once, and rows of a partition where forests are fitted in parts:
#: each partition sends the statistics of all nodes, of which deep trees have nearly as many as rows.
NODES_AT_ONCE, PART_ROWS = 3_000_000, 100_000


class SearchedForest(NamedTuple):
    """Scores of a grid, and the best setting's forest as a function that adds its predictions."""

    avgMetrics: list[float]
    transform: Callable[[DataFrame], DataFrame]


def _tree_nodes(rows: int, depth: int) -> int:
    """Nodes of a tree at most."""
    return min(2 ** (depth + 1), 2 * rows)


def forest_in_parts(forest: RandomForestRegressor, train: DataFrame, df: DataFrame, nodes: int) -> DataFrame:
    """``df`` with the predictions of ``forest`` fitted on ``train``, of whose trees no more than ``nodes`` nodes are held.

    A forest predicts the mean of its trees, and they do not depend on each other: its trees are fitted in parts, each
    with a seed of its own, and a part is forgotten once its predictions are added to the rows.
    """
    trees, seed = forest.getNumTrees(), forest.getSeed()
    part = max(1, nodes // _tree_nodes(train.count(), forest.getMaxDepth()))
    summed = df.withColumn("__sum", F.lit(0.0))
    for k, begin in enumerate(range(0, trees, part)):
        n = min(part, trees - begin)
        model = forest.copy({forest.numTrees: n, forest.seed: seed + k}).fit(train)
        summed = cut_lineage(model.transform(summed).withColumn("__sum", F.col("__sum") + n * F.col("prediction")).drop("prediction"))
    return summed.withColumn("prediction", F.col("__sum") / trees).drop("__sum")


def _search_in_parts(forest: RandomForestRegressor, grid: list[dict], train: DataFrame, fold_col: str, folds: int,
                     evaluator: RegressionEvaluator) -> SearchedForest:
    """``CrossValidator`` over explicit folds for forests that the driver should not hold whole."""
    from concurrent.futures import ThreadPoolExecutor

    partitions = max(1, -(-train.count() // PART_ROWS))
    train = cut_lineage(train.coalesce(partitions))
    fits = max(1, train.sparkSession.sparkContext.defaultParallelism // partitions)

    def score(task):
        params, fold = task
        held = forest_in_parts(forest.copy(params), train.where(F.col(fold_col) != fold), train.where(F.col(fold_col) == fold),
                               NODES_AT_ONCE // fits)
        return evaluator.evaluate(held)

    with ThreadPoolExecutor(max_workers=fits) as pool:
        found = list(pool.map(score, [(params, fold) for params in grid for fold in range(folds)]))
    scores = [sum(found[i : i + folds]) / folds for i in range(0, len(found), folds)]
    best = forest.copy(grid[scores.index(max(scores))])
    return SearchedForest(scores, lambda df: forest_in_parts(best, train, df, NODES_AT_ONCE))


def grid_search(train: DataFrame, label: str, fold_col: str, trees: Sequence[int], depths: Sequence[int],
                min_leaf: Sequence[int], seed: int = 42, parallelism: int = 4):
    """Cross-validated forest grid scored by R^2 on explicit (contiguous) folds; refits the best.

    Where the fits that run at the same time could have more than ``NODES_AT_ONCE`` nodes, forests are fitted in parts.
    """
    # node numbers are kept with the rows: sending all deep trees to the tasks of every level costs more than the splits
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, featureSubsetStrategy="all", cacheNodeIds=True)
    grid = (ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths))
            .addGrid(rf.minInstancesPerNode, list(min_leaf)).build())
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, foldCol=fold_col, parallelism=parallelism,
                        evaluator=RegressionEvaluator(labelCol=label, metricName="r2"))
    most = max(trees) * _tree_nodes(train.count(), max(depths))
    if most * parallelism > NODES_AT_ONCE:
        return _search_in_parts(rf, grid, train, fold_col, cv.getNumFolds(), cv.getEvaluator()), grid
    model = cv.fit(train)
    return model, grid


def mlp(layers: Sequence[int], seed: int = 42, max_iter: int = 100, label: str = "label"):
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=list(layers),
                                          maxIter=max_iter, seed=seed, blockSize=128)


def kmeans_sweep(data: DataFrame, ks: Sequence[int], restarts: int = 10, seed: int = 42,
                 parallelism: int = 4) -> tuple[DataFrame, dict]:
    """Per k: the lowest-cost fit over ``restarts`` seeds; inertia and silhouette (squared Euclidean).

    Returns the table and the chosen model of each k.

    The (k, seed) fits are independent, so they are submitted as concurrent
    Spark jobs from a small thread pool (as ``CrossValidator(parallelism)``
    does); each fit is seeded, so the result does not depend on scheduling.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = data.sparkSession
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")

    def fit(task):
        k, r = task
        m = KMeans(k=k, seed=seed + r, featuresCol="features").fit(data)
        return k, r, m.summary.trainingCost, m

    tasks = [(int(k), r) for k in ks for r in range(restarts)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fits = list(pool.map(fit, tasks))
    best: dict[int, tuple] = {}
    for k, r, cost, m in fits:  # lowest cost; ties -> lowest restart index
        if k not in best or (cost, r) < (best[k][0], best[k][1]):
            best[k] = (cost, r, m)

    def score(k):
        return k, ev.evaluate(best[k][2].transform(data))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        sil = dict(pool.map(score, sorted(best)))
    out = [(k, float(best[k][0]), float(sil[k])) for k in sorted(best)]
    return (spark.createDataFrame(out, "k int, inertia double, silhouette double"),
            {k: m for k, (_, _, m) in best.items()})


def pca_fit(df: DataFrame, k: int, features: str = "features"):
    return PCA(k=k, inputCol=features, outputCol="pca").fit(df)


def pca_reconstruct(df: DataFrame, arr_col: str, mean: list[float], components: list[list[float]],
                    out: str = "recon", clamp: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """x_hat = mean + sum_j <x - mean, pc_j> pc_j, with the (bounded) components as literals.

    ``components`` is k x d (k, d = model sizes, independent of data size).
    """
    mu = F.array(*[F.lit(float(m)) for m in mean])
    centred = F.zip_with(F.col(arr_col), mu, lambda x, m: x.cast("double") - m)
    staged = df.withColumn("__c", centred)
    codes = F.array(*[F.aggregate(F.zip_with(F.col("__c"), F.array(*[F.lit(float(v)) for v in pc]),
                                             lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
                      for pc in components])
    staged = staged.withColumn("__z", codes)
    d = len(mean)
    recon = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.lit(0.0) + F.element_at(mu, i + 1) + reduce(
        lambda acc, j: acc + F.element_at(F.col("__z"), j + 1) * F.element_at(
            F.array(*[F.lit(float(pc_row)) for pc_row in [components[j][t] for t in range(d)]]), i + 1),
        range(len(components)), F.lit(0.0)))
    if clamp is not None:
        recon = F.transform(recon, lambda v: F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), v)))
    return staged.withColumn(out, recon).drop("__c", "__z")


def save_and_reload(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


__all__ = [
    "assemble", "regressors", "regression_compare", "classifiers", "classification_scores",
    "feature_importance", "comparison_table", "forest_in_parts", "grid_search", "mlp", "kmeans_sweep",
    "pca_fit", "pca_reconstruct", "save_and_reload",
]
