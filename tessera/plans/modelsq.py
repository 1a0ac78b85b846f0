"""Model, clustering and projection queries (rows-only checks: learners are not SQL).

All settings are those of the learners as documented: 100 trees and rounds for
regression and forecasts, 300 for the classifiers, 10 k-means restarts, the
full grid. Training frames are written once and laid out in few partitions
where they are small, since the learners run a job per tree level.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import arrays as ar
from tessera.operators import clusters as cl
from tessera.operators import density as dn
from tessera.operators import features as fe
from tessera.operators import metrics as me
from tessera.operators import models as mo
from tessera.operators import spatial as sa
from tessera.operators import splits as sp
from tessera.operators import timeseries as ts
from tessera.operators.ordering import global_index
from tessera.plans.registry import register
from tessera.session import cut_lineage, scratch_path, stored
from tessera.sources import files as fs
from tessera.sources.tables import Tables

REGRESSION_TREES, REGRESSION_ROUNDS = 100, 100
CLASSIFIER_TREES, CLASSIFIER_ROUNDS = 300, 300
RESTARTS = 10
GRID_TREES, GRID_DEPTHS, GRID_MIN_LEAF = [50, 100, 200], [5, 10, 30], [1, 2]
#: Most L-BFGS iterations of the dense classifiers (they end earlier where the loss stands still).
DENSE_ITERATIONS = 100
DENSE_LAYERS = {"dense_small": [512, 256], "dense_deep": [1024, 512, 256, 128]}
#: Rows of a training partition: at most, and at least where there are cores for more partitions. Each partition sends
#: the statistics of all nodes of a level, whatever its rows: beyond a partition per core, more of them only cost.
TRAIN_ROWS, LEAST_ROWS = 500_000, 1_500
#: The same for rows that are clustered.
CLUSTER_ROWS = 50_000
CHURN_FEATURES = ["c_acctbal", "n_orders", "total_spent", "avg_price", "c_nationkey", "segment"]
CLUSTER_FEATURES = CHURN_FEATURES

_memo: dict = {}


def customer_table(t) -> DataFrame:
    """Customers with order aggregates and a churn label (no order in the last 365 days of data)."""
    last_day = t.orders.agg(F.max("o_orderdate")).first()[0]
    cutoff = (last_day - dt.timedelta(days=365)) if last_day else None
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total_spent"),
        F.avg("o_totalprice").alias("avg_price"), F.max("o_orderdate").alias("last_order"))
    c = fe.label_encode(t.customer, "c_mktsegment", "segment").join(per, "c_custkey", "left")
    churned = F.when(F.col("last_order").isNull() | (F.col("last_order") < F.lit(str(cutoff)).cast("timestamp_ntz")), 1).otherwise(0)
    return c.select(
        "c_custkey", "c_acctbal", "c_nationkey", F.coalesce("segment", F.lit(-1)).alias("segment"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("total_spent", F.lit(0.0)).alias("total_spent"),
        F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"), churned.cast("double").alias("label"))


def _training(df: DataFrame, most: int | None = None) -> DataFrame:
    """The frame, written once: a partition per core, but not below ``LEAST_ROWS`` rows nor beyond ``most`` (``TRAIN_ROWS``)."""
    kept = cut_lineage(df)
    n, cores = kept.count(), df.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, -(-n // (most or TRAIN_ROWS)), min(cores, n // LEAST_ROWS))
    return kept.coalesce(wanted) if wanted <= kept.rdd.getNumPartitions() else cut_lineage(kept.repartition(wanted))


def _churn(spark, sf_dir):
    key = ("churn", sf_dir, spark.sparkContext.applicationId)
    if key in _memo:
        return _memo[key]
    t = Tables(spark, sf_dir)
    split = sp.stratified_split(customer_table(t), "label", "c_custkey", 0.8, 42)
    data = _training(mo.assemble(split, CHURN_FEATURES))
    # weights of the training rows alone
    train = _training(fe.with_class_weight(data.where("split = 'train'"), "label", "weight"))
    test = data.where("split = 'test'")
    fitted = mo.fit_all(mo.classifiers(42, CLASSIFIER_TREES, CLASSIFIER_ROUNDS, "weight"), train)
    scores = []
    for name, m in fitted.items():
        scores.append(mo.classification_scores(m.transform(test), "label").select(F.lit(name).alias("model"), "*"))
    long = cut_lineage(scores[0].unionByName(scores[1]))
    _memo[key] = (data, train, test, fitted, long)
    return _memo[key]


@register("churn_classify")
def churn_classify(spark, sf_dir):
    return _churn(spark, sf_dir)[4]


@register("model_comparison")
def model_comparison(spark, sf_dir):
    return mo.comparison_table(_churn(spark, sf_dir)[4], ["accuracy", "precision", "recall", "f1", "roc_auc"])


def _best_name(long: DataFrame) -> DataFrame:
    """Highest AUC, the smallest name on a tie."""
    auc = long.where(F.col("metric") == "roc_auc")
    return auc.agg(F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best_model"),
                   F.max("value").alias("roc_auc"))


@register("best_model")
def best_model(spark, sf_dir):
    return _best_name(_churn(spark, sf_dir)[4])


@register("feature_importance")
def feature_importance(spark, sf_dir):
    _, _, _, fitted, long = _churn(spark, sf_dir)
    best = _best_name(long).first()["best_model"]
    return mo.feature_importance(fitted[best], CHURN_FEATURES, spark)


@register("class_report_model")
def class_report_model(spark, sf_dir):
    _, _, test, fitted, long = _churn(spark, sf_dir)
    best = _best_name(long).first()["best_model"]
    pred = fitted[best].transform(test).select(F.col("label").cast("int").alias("label"),
                                               F.col("prediction").cast("int").alias("prediction"))
    return me.class_report(pred, "label", "prediction")


@register("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """The chosen classifier, saved with its feature step and loaded again: equal predictions on the test rows."""
    _, _, test, fitted, long = _churn(spark, sf_dir)
    best = fitted[_best_name(long).first()["best_model"]]
    pipe = PipelineModel(stages=[VectorAssembler(inputCols=CHURN_FEATURES, outputCol="features"), best])
    reloaded = mo.save_and_reload(pipe, scratch_path(spark, "model"))
    a = pipe.transform(test.drop("features")).select("c_custkey", F.col("prediction").alias("p1"))
    b = reloaded.transform(test.drop("features")).select("c_custkey", F.col("prediction").alias("p2"))
    return a.join(b, "c_custkey").agg(F.count(F.lit(1)).alias("n"),
                                      F.count_if(F.col("p1") == F.col("p2")).alias("n_equal"))


def _lineitem_model_frame(t):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    li = t.lineitem.join(part, "l_partkey").withColumn(
        "row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    cols = ["l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size"]
    return sp.hash_split(mo.assemble(li.withColumn("label", F.col("l_extendedprice")), cols), "row_id", 0.8, 42)


@register("regress_compare")
def regress_compare(spark, sf_dir):
    return _regression(spark, sf_dir)


def _regression(spark, sf_dir):
    key = ("regression", sf_dir, spark.sparkContext.applicationId)
    if key not in _memo:
        data = _training(_lineitem_model_frame(Tables(spark, sf_dir)).select("features", "label", "split"))
        train, test = data.where("split = 'train'"), data.where("split = 'test'")
        models = mo.regressors(42, REGRESSION_TREES, REGRESSION_ROUNDS)
        _memo[key] = cut_lineage(mo.regression_compare(train, test, "label", models))
    return _memo[key]


@register("best_regressor")
def best_regressor(spark, sf_dir):
    """The regressor with the highest R2 above 0 ('' and 0 if none is), the first in order on a tie."""
    good = _regression(spark, sf_dir).where(F.col("r2") > 0)
    order = F.when(F.col("model") == "linear_regression", 0).when(F.col("model") == "random_forest", 1).otherwise(2)
    return good.agg(F.coalesce(F.min_by("model", F.struct(-F.col("r2"), order)), F.lit("")).alias("best_model"),
                    F.coalesce(F.max("r2"), F.lit(0.0)).alias("r2"))


def _supplier_table(t) -> DataFrame:
    """Suppliers with aggregates of all their lines; the label is their revenue."""
    lines = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.avg("l_quantity").alias("mean_quantity"),
        F.avg("l_discount").alias("mean_discount"), F.count_distinct("l_partkey").alias("n_parts"),
        F.sum("l_extendedprice").alias("label"))
    return t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey").join(lines, "s_suppkey")


@register("grid_search")
def grid_search(spark, sf_dir):
    """Every setting with its cross-validated R2; the best one refitted, with its hold-out errors."""
    split = sp.hash_split(_supplier_table(Tables(spark, sf_dir)), "s_suppkey", 0.8, 42)
    features = ["s_acctbal", "s_nationkey", "n_lines", "mean_quantity", "mean_discount", "n_parts"]
    test = mo.assemble(split.where("split = 'test'"), features)
    chosen = split.where("split = 'train'")
    n = chosen.count()
    # contiguous folds in key order (an unshuffled 3-fold split)
    idx = global_index(chosen, ["s_suppkey"], "__i", rows=n)
    folded = idx.withColumn("fold", F.floor(F.col("__i") * 3 / F.lit(max(n, 1))).cast("int"))
    data = _training(mo.assemble(folded, features))
    model, grid = mo.grid_search(data, "label", "fold", GRID_TREES, GRID_DEPTHS, GRID_MIN_LEAF, parallelism=8)
    held = me.regression_metrics(model.transform(test), "label", "prediction").first()
    rows = []
    for params, score in zip(grid, model.avgMetrics):
        p = {k.name: v for k, v in params.items()}
        rows.append((int(p["numTrees"]), int(p["maxDepth"]), int(p["minInstancesPerNode"]), float(score)))
    res = spark.createDataFrame(rows, "num_trees int, max_depth int, min_leaf int, cv_r2 double")
    w = Window.orderBy(F.desc("cv_r2"), "num_trees", "max_depth", "min_leaf")
    best = res.withColumn("is_best", F.row_number().over(w) == 1)
    return best.select("*", *[F.when(F.col("is_best"), F.lit(held[m])).alias(f"holdout_{m}") for m in ("mae", "rmse", "r2")])


@register("forecast")
def forecast(spark, sf_dir):
    key = ("forecast", sf_dir, spark.sparkContext.applicationId)
    if key not in _memo:
        feats = ts.ts_features(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice")
        split = ts.ordered_split(feats, "date", 0.8)
        data = _training(mo.assemble(split, ["lag_1", "lag_2", "lag_3", "rolling_3"])
                         .withColumn("label", F.col("total")))
        model = mo.regressors(42, REGRESSION_TREES, REGRESSION_ROUNDS)["gradient_boosting"].fit(data.where("split = 'train'"))
        pred = model.transform(data)
        _memo[key] = cut_lineage(pred.select("date", "split", F.col("total").alias("actual"),
                                             F.round("prediction", 2).alias("forecast"),
                                             F.col("lag_1").alias("baseline")))
    return _memo[key]


@register("forecast_metrics")
def forecast_metrics(spark, sf_dir):
    f = forecast(spark, sf_dir).where("split = 'test'")
    a = me.regression_metrics(f, "actual", "forecast").select(F.lit("gradient_boosting").alias("model"), "*")
    b = me.regression_metrics(f, "actual", "baseline").select(F.lit("lag_1_baseline").alias("model"), "*")
    return a.unionByName(b)


def _embedding_frame(t):
    emb = t.embeddings.select("vec_id", "label", array_to_vector(ar.as_double("embedding")).alias("features"))
    return sp.exact_split(emb, "vec_id", 0.15, 7)


@register("mlp_accuracy")
def mlp_accuracy(spark, sf_dir):
    data = _training(_embedding_frame(Tables(spark, sf_dir)).withColumn("label", F.col("label").cast("double")))
    k = int(data.agg(F.max("label")).first()[0]) + 1
    width = data.first()["features"].size
    train, test = data.where("split = 'train'"), data.where("split = 'val'")
    nets = {name: mo.mlp([width, *hidden, k], 42, DENSE_ITERATIONS) for name, hidden in DENSE_LAYERS.items()}
    rows = []
    for name, net in mo.fit_all(nets, train).items():
        pred = net.transform(test)
        acc = me.class_metrics(pred.withColumn("y", F.col("label").cast("int"))
                               .withColumn("p", F.col("prediction").cast("int")), "y", "p").select("accuracy")
        rows.append(acc.select(F.lit(name).alias("model"), "accuracy"))
    return rows[0].unionByName(rows[1])


def _scaled_customers(spark, sf_dir):
    key = ("scaled", sf_dir, spark.sparkContext.applicationId)
    if key not in _memo:
        _memo[key] = _scale(spark, sf_dir)
    return _memo[key]


def _scale(spark, sf_dir):
    cust = customer_table(Tables(spark, sf_dir))
    moments = fe.fit_standard_scaler(cust, CLUSTER_FEATURES)
    scaled = fe.apply_standard_scaler(cust, moments, "_z")
    return _training(mo.assemble(scaled, [c + "_z" for c in CLUSTER_FEATURES]), CLUSTER_ROWS)


def _sweep(spark, sf_dir):
    """(scaled customers, (k, inertia, silhouette), the same with the cluster of the best k); Euclidean silhouettes decide."""
    key = ("sweep", sf_dir, spark.sparkContext.applicationId)
    if key not in _memo:
        data = _scaled_customers(spark, sf_dir)
        scaled = [c + "_z" for c in CLUSTER_FEATURES]
        best = cl.kmeans(data, "c_custkey", scaled, range(2, 9), RESTARTS, 42)
        assigned = stored(cl.assign(data.drop("features"), scaled, {f"__k{k}": c for k, (_, c) in best.items()}), "kmeans")
        found = cl.silhouettes(assigned, "c_custkey", scaled, [f"__k{k}" for k in best]).collect()
        score = {int(r["clustering"][3:]): r["silhouette"] for r in found}
        sweep = spark.createDataFrame([(k, inertia, score[k]) for k, (inertia, _) in sorted(best.items())],
                                      "k int, inertia double, silhouette double")
        best_k = max(sorted(score), key=lambda k: score[k])
        _memo[key] = (data, sweep, assigned.withColumn("kmeans_cluster", F.col(f"__k{best_k}")).drop(*[f"__k{k}" for k in best]))
    return _memo[key]


def _profile(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 4).alias("churn_rate"),
        *[F.round(F.avg(c), 2).alias(f"mean_{c}") for c in CLUSTER_FEATURES])


def _segments(spark, sf_dir) -> DataFrame:
    """Customers with encodings, features and both cluster ids, one row each."""
    assigned = _sweep(spark, sf_dir)[2]
    return assigned.drop(*[c + "_z" for c in CLUSTER_FEATURES]).join(
        _dbscan(spark, sf_dir).select("c_custkey", F.col("cluster").alias("dbscan_cluster")), "c_custkey")


@register("customer_segments")
def customer_segments(spark, sf_dir):
    """The segment table, written as CSV and read back."""
    seg = _segments(spark, sf_dir)
    return fs.read_csv(spark, fs.write_csv(seg, scratch_path(spark, "segments-csv")), seg.schema)


@register("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)[1]


@register("kmeans_assign")
def kmeans_assign(spark, sf_dir):
    """Profile of the clusters that the sweep chose."""
    return _profile(_sweep(spark, sf_dir)[2], "kmeans_cluster")


@register("pca_2d")
def pca_2d(spark, sf_dir):
    """Two axes of the scaled features, with both cluster ids."""
    data, _, assigned = _sweep(spark, sf_dir)
    model = mo.pca_fit(data, 2)
    out = model.transform(mo.assemble(assigned, [c + "_z" for c in CLUSTER_FEATURES])).select("c_custkey", "kmeans_cluster", vector_to_array("pca").alias("pc"))
    other = _dbscan(spark, sf_dir).select("c_custkey", F.col("cluster").alias("dbscan_cluster"))
    return out.join(other, "c_custkey").select(
        "c_custkey", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"), "kmeans_cluster", "dbscan_cluster")


def _denoised(spark, sf_dir):
    """Test images (15 % exact split) with clean, noisy and PCA-denoised pixels."""
    from tessera.plans.arraysq import NOISE_SEED, _scaled

    t = Tables(spark, sf_dir)
    clean = sp.exact_split(_scaled(t).select("vec_id", "scaled"), "vec_id", 0.15, 7)
    train = cut_lineage(clean.where("split = 'train'").select("vec_id", array_to_vector("scaled").alias("features")))
    d = len(clean.select("scaled").first()[0])
    model = mo.pca_fit(train, 16)
    mean = train.select(vector_to_array("features").alias("a")).select(
        F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(d - 1)).alias("i"), F.col("a").alias("x")))) \
        .groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    mean = [r["m"] for r in mean]
    comps = model.pc.toArray().T.tolist()  # k x d, bounded by the model size
    test = clean.where("split = 'val'").withColumn("noisy", ar.corrupt("scaled", "vec_id", 0.30, 0.15, NOISE_SEED))
    return mo.pca_reconstruct(test, "noisy", mean, comps, "denoised")


@register("pca_denoise")
def pca_denoise(spark, sf_dir):
    recon = _denoised(spark, sf_dir)
    return recon.select("vec_id", F.round(ar.psnr(ar.mse("scaled", "noisy")), 6).alias("psnr_noisy"),
                        F.round(ar.psnr(ar.mse("scaled", "denoised")), 6).alias("psnr_denoised"))


@register("psnr_eval")
def psnr_eval(spark, sf_dir):
    per = pca_denoise(spark, sf_dir)
    return per.agg(F.count(F.lit(1)).alias("n_test"), F.round(F.avg("psnr_noisy"), 4).alias("mean_psnr_noisy"),
                   F.round(F.avg("psnr_denoised"), 4).alias("mean_psnr_denoised")).withColumn(
        "gain", F.round(F.col("mean_psnr_denoised") - F.col("mean_psnr_noisy"), 4))


@register("denoise_examples")
def denoise_examples(spark, sf_dir):
    """Sample-grid data: the first 8 test images (by id) as clean / noisy / denoised 8x8 grids."""
    first = _denoised(spark, sf_dir).orderBy("vec_id").limit(8)
    return first.select("vec_id", ar.as_image("scaled", 8, 8).alias("clean"),
                        ar.as_image("noisy", 8, 8).alias("noisy"),
                        ar.as_image("denoised", 8, 8).alias("denoised"))


@register("silhouette")
def silhouette(spark, sf_dir):
    """Silhouette of the given embedding labels as clusters (squared Euclidean, MLlib).

    The evaluator works from per-cluster sums (no pairwise distances), so it
    scales with the data; sklearn's Euclidean silhouette needs all pairs.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator

    emb = Tables(spark, sf_dir).embeddings.select(
        array_to_vector(ar.as_double("embedding")).alias("features"), F.col("label").cast("double").alias("prediction"))
    k = emb.select("prediction").distinct().count()
    score = ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(emb)
    return spark.createDataFrame([(int(k), float(score))], "n_clusters int, silhouette double")


@register("silhouette_exact", sql="""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT label, count(*) AS n FROM v GROUP BY label),
s AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS d FROM v a, v b GROUP BY ALL),
m AS (SELECT vec_id, any_value(o.n) AS n, max(CASE WHEN other = s.label THEN d / greatest(o.n - 1, 1) END) AS a,
             min(CASE WHEN other <> s.label THEN d / t.n END) AS b
      FROM s JOIN n o ON o.label = s.label JOIN n t ON t.label = s.other GROUP BY vec_id)
SELECT count(*) AS n_points, CAST((SELECT count(*) FROM n) AS INTEGER) AS n_clusters,
       round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM m
""")
def silhouette_exact(spark, sf_dir):
    """Euclidean silhouette of the given embedding labels as clusters, from all pairs."""
    emb = Tables(spark, sf_dir).embeddings
    wide = len(emb.where(F.col("embedding").isNotNull()).first()["embedding"])
    rows = emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(wide)])
    return cl.silhouettes(rows, "vec_id", [f"e{i}" for i in range(wide)], ["label"]).select(
        "n_points", "n_clusters", F.round("silhouette", 9).alias("silhouette"))


# ---- density clustering on the standardized customer features --------------------

DB_EPS, DB_MIN = 1.2, 10
PAIR_EPS = 0.6


def _dbscan(spark, sf_dir):
    key = ("dbscan", sf_dir, spark.sparkContext.applicationId)
    if key not in _memo:
        points = _scaled_customers(spark, sf_dir).select("c_custkey", *[c + "_z" for c in CLUSTER_FEATURES])
        _memo[key] = cut_lineage(dn.dbscan(points, "c_custkey", [c + "_z" for c in CLUSTER_FEATURES], DB_EPS, DB_MIN))
    return _memo[key]


_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(CLUSTER_FEATURES))
_D2 = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(CLUSTER_FEATURES)))
_CUSTOMER_SQL = """
per AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_spent, avg(o_totalprice) AS avg_price,
               max(o_orderdate) AS last_order
        FROM orders GROUP BY o_custkey),
seg AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code
        FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)),
c AS (SELECT c_custkey, c_acctbal, c_nationkey, coalesce(n_orders, 0) AS n_orders, coalesce(total_spent, 0.0) AS total_spent,
             coalesce(avg_price, 0.0) AS avg_price, coalesce(code, -1) AS segment,
             CASE WHEN last_order IS NULL OR last_order < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY
                  THEN 1.0 ELSE 0.0 END AS label
      FROM customer LEFT JOIN per ON c_custkey = o_custkey LEFT JOIN seg ON c_mktsegment = s)"""
_SCALED_SQL = f"""{_CUSTOMER_SQL},
z AS (SELECT c_custkey, {_Z} FROM c)"""
# neighbours, core points, what core points reach through core points, clusters by their smallest core id
_DBSCAN_SQL = f"""{_SCALED_SQL},
e AS MATERIALIZED (SELECT a.c_custkey AS u, b.c_custkey AS w FROM z a JOIN z b ON {_D2} <= {DB_EPS * DB_EPS}),
k AS (SELECT u AS id, count(*) >= {DB_MIN} AS is_core FROM e GROUP BY u),
ce AS MATERIALIZED (SELECT u, w FROM e WHERE u <> w AND u IN (SELECT id FROM k WHERE is_core) AND w IN (SELECT id FROM k WHERE is_core)),
r(u, w) AS (SELECT u, w FROM ce UNION SELECT r.u, ce.w FROM r JOIN ce ON r.w = ce.u),
co AS (SELECT id, least(id, coalesce((SELECT min(w) FROM r WHERE r.u = id), id)) AS comp FROM k WHERE is_core),
nb AS (SELECT e.u AS id, min(co.comp) AS comp FROM e JOIN co ON co.id = e.w GROUP BY e.u),
nu AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM co)),
db AS (SELECT k.id AS c_custkey, CAST(coalesce(nu.cluster, -1) AS INTEGER) AS cluster, is_core
       FROM k LEFT JOIN co USING (id) LEFT JOIN nb USING (id) LEFT JOIN nu ON nu.comp = coalesce(co.comp, nb.comp))"""


@register("eps_pairs", sql=f"""
WITH {_SCALED_SQL}
SELECT a.c_custkey AS a, b.c_custkey AS b, round(sqrt({_D2}), 6) AS distance
FROM z a JOIN z b ON a.c_custkey < b.c_custkey AND {_D2} <= {PAIR_EPS * PAIR_EPS}
""")
def eps_pairs(spark, sf_dir):
    """Customers at most ``PAIR_EPS`` apart in the standardized features."""
    points = _scaled_customers(spark, sf_dir).select("c_custkey", *[c + "_z" for c in CLUSTER_FEATURES])
    found = sa.eps_pairs(points, "c_custkey", [c + "_z" for c in CLUSTER_FEATURES], PAIR_EPS)
    return found.withColumn("distance", F.round("distance", 6))


@register("dbscan", sql=f"WITH RECURSIVE {_DBSCAN_SQL} SELECT c_custkey, cluster, is_core FROM db")
def dbscan(spark, sf_dir):
    return _dbscan(spark, sf_dir)


@register("dbscan_core", sql=f"""
WITH {_SCALED_SQL},
n AS (SELECT a.c_custkey, count(*) AS n FROM z a JOIN z b ON {_D2} <= {DB_EPS * DB_EPS} GROUP BY a.c_custkey)
SELECT c_custkey, n >= {DB_MIN} AS is_core FROM n
""")
def dbscan_core(spark, sf_dir):
    return _dbscan(spark, sf_dir).select("c_custkey", "is_core")


@register("dbscan_summary", sql=f"""
WITH RECURSIVE {_DBSCAN_SQL}
SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, count(*) FILTER (cluster = -1) AS n_noise,
       count(*) FILTER (is_core) AS n_core, count(*) AS n_points
FROM db
""")
def dbscan_summary(spark, sf_dir):
    d = _dbscan(spark, sf_dir)
    return d.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
                 F.count_if(F.col("cluster") == -1).alias("n_noise"),
                 F.count_if("is_core").alias("n_core"), F.count(F.lit(1)).alias("n_points"))


_MEANS_SQL = ", ".join(f"round(avg({c}), 2) AS mean_{c}" for c in CLUSTER_FEATURES)


@register("dbscan_profile", sql=f"""
WITH RECURSIVE {_DBSCAN_SQL}
SELECT cluster, count(*) AS n, round(avg(label), 4) AS churn_rate, {_MEANS_SQL} FROM db JOIN c USING (c_custkey) GROUP BY cluster
""")
def dbscan_profile(spark, sf_dir):
    """Profile of the density clusters, noise (-1) included."""
    return _profile(_segments(spark, sf_dir), "dbscan_cluster")
