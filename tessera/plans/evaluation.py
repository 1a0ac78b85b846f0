"""Metric aggregates and training-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history as hi
from tessera.operators import metrics as me
from tessera.operators import splits as sp
from tessera.plans.prep import _EPOCH_H
from tessera.plans.registry import register
from tessera.sources.tables import Tables


def _scored_lineitems(t):
    # fixed-rule prediction of the extended price: quantity x list price of the part
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return t.lineitem.join(part, "l_partkey").select(
        "l_extendedprice", (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"))


@register("regression_metrics", sql="""
SELECT count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * p_retailprice)), 6) AS mae,
       round(sqrt(avg(pow(l_extendedprice - l_quantity * p_retailprice, 2))), 6) AS rmse,
       round(1 - sum(pow(l_extendedprice - l_quantity * p_retailprice, 2))
                 / (var_pop(l_extendedprice) * count(l_extendedprice)), 6) AS r2
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_extendedprice IS NOT NULL AND l_quantity * p_retailprice IS NOT NULL
""")
def regression_metrics(spark, sf_dir):
    return me.regression_metrics(_scored_lineitems(Tables(spark, sf_dir)), "l_extendedprice", "pred")


def _label_rule(t):
    # actual = toxic; rule prediction = "low quality means toxic"
    return t.labels.select("doc_id", "toxic", (1 - F.col("quality")).alias("predicted"))


_RULE = "(SELECT doc_id, toxic, 1 - quality AS predicted FROM labels)"


@register("confusion_matrix", sql=f"""
WITH g AS (SELECT a AS toxic, p AS predicted FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p)),
c AS (SELECT CAST(toxic AS INTEGER) AS toxic, CAST(predicted AS INTEGER) AS predicted, count(*) AS count
      FROM {_RULE} GROUP BY 1, 2)
SELECT g.toxic, g.predicted, coalesce(c.count, 0) AS count FROM g LEFT JOIN c USING (toxic, predicted)
""")
def confusion_matrix(spark, sf_dir):
    return me.confusion_matrix(_label_rule(Tables(spark, sf_dir)), "toxic", "predicted")


@register("class_metrics", sql=f"""
WITH c AS (SELECT count_if(toxic = 1 AND predicted = 1) AS tp, count_if(toxic <> 1 AND predicted = 1) AS fp,
                  count_if(toxic = 1 AND predicted <> 1) AS fn, count_if(toxic = predicted) AS correct,
                  count(*) AS n FROM {_RULE})
SELECT round(coalesce(correct / nullif(n, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c
""")
def class_metrics(spark, sf_dir):
    return me.class_metrics(_label_rule(Tables(spark, sf_dir)), "toxic", "predicted")


@register("class_report", sql=f"""
WITH c AS (SELECT count(*) AS n, count_if(toxic = predicted) AS correct,
                  count_if(toxic = 0 AND predicted = 0) AS tp0, count_if(predicted = 0) AS pp0, CAST(count_if(toxic = 0) AS BIGINT) AS s0,
                  count_if(toxic = 1 AND predicted = 1) AS tp1, count_if(predicted = 1) AS pp1, CAST(count_if(toxic = 1) AS BIGINT) AS s1
           FROM {_RULE}),
m AS (SELECT *, coalesce(tp0 / nullif(pp0, 0), 0) AS p0, coalesce(tp0 / nullif(s0, 0), 0) AS r0,
             coalesce(2 * tp0 / nullif(pp0 + s0, 0), 0) AS f0,
             coalesce(tp1 / nullif(pp1, 0), 0) AS p1, coalesce(tp1 / nullif(s1, 0), 0) AS r1,
             coalesce(2 * tp1 / nullif(pp1 + s1, 0), 0) AS f1 FROM c)
SELECT '0' AS class_label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM m
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(coalesce(correct / nullif(n, 0), 0), 6), n FROM m
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2.0, 6), round((r0 + r1) / 2.0, 6), round((f0 + f1) / 2.0, 6), n FROM m
UNION ALL SELECT 'weighted avg', round(coalesce((p0 * s0 + p1 * s1) / nullif(n, 0), 0), 6),
                 round(coalesce((r0 * s0 + r1 * s1) / nullif(n, 0), 0), 6),
                 round(coalesce((f0 * s0 + f1 * s1) / nullif(n, 0), 0), 6), n FROM m
""")
def class_report(spark, sf_dir):
    return me.class_report(_label_rule(Tables(spark, sf_dir)), "toxic", "predicted")


@register("roc_auc", sql="""
WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS s, count_if(quality = 1) AS pos, count_if(quality <> 1) AS neg
           FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS auc FROM c
""")
def roc_auc(spark, sf_dir):
    t = Tables(spark, sf_dir)
    scored = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return me.roc_auc(scored, "quality", "n_chars")


@register("log_loss", sql="""
SELECT count(*) AS n,
       round(avg(-ln(CASE WHEN quality = 1 THEN least(greatest(n_chars / 20000.0, 1e-7), 1 - 1e-7)
                          ELSE 1 - least(greatest(n_chars / 20000.0, 1e-7), 1 - 1e-7) END)), 9) AS log_loss
FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL
""")
def log_loss(spark, sf_dir):
    t = Tables(spark, sf_dir)
    scored = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id") \
        .withColumn("p1", F.col("n_chars") / F.lit(20000.0))
    return me.log_loss(scored, "quality", "p1")


def _history(t):
    return hi.daily_history(t.events, "event_type", "ts", "value")


_HIST_SQL = """
d AS (SELECT event_type AS run, CAST(ts AS DATE) AS day, round(avg(value), 9) AS val_loss
      FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
h AS (SELECT run, day, val_loss, CAST(row_number() OVER (PARTITION BY run ORDER BY day) AS INTEGER) AS epoch FROM d),
b AS (SELECT *, prior IS NULL OR val_loss < prior AS is_best
      FROM (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM h))
"""


@register("history_best", sql=f"WITH {_HIST_SQL} SELECT run, day, val_loss, epoch, is_best FROM b")
def history_best(spark, sf_dir):
    return hi.new_best(_history(Tables(spark, sf_dir)))


@register("history_early_stop", sql=f"""
WITH {_HIST_SQL},
w AS (SELECT *, epoch - max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wait FROM b),
s AS (SELECT run, coalesce(min(CASE WHEN wait >= 3 THEN epoch END), max(epoch)) AS stop_epoch,
             min(CASE WHEN wait >= 3 THEN epoch END) IS NOT NULL AS stopped_early FROM w GROUP BY run)
SELECT s.run, stop_epoch, stopped_early, first(epoch ORDER BY val_loss, epoch) AS best_epoch, min(val_loss) AS best_val
FROM s JOIN h ON h.run = s.run AND h.epoch <= s.stop_epoch GROUP BY s.run, stop_epoch, stopped_early
""")
def history_early_stop(spark, sf_dir):
    return hi.early_stop(_history(Tables(spark, sf_dir)), patience=3)


@register("history_plateau", sql=f"""
WITH RECURSIVE {_HIST_SQL},
r AS (SELECT DISTINCT run, 0 AS epoch, 'inf'::DOUBLE AS best, 0 AS bad, 0.002::DOUBLE AS lr FROM h
      UNION ALL
      SELECT run, epoch, best2 AS best, CASE WHEN bad1 > 2 THEN 0 ELSE bad1 END AS bad,
             CASE WHEN bad1 > 2 AND lr - greatest(lr * 0.5, 0.0) > 1e-8 THEN greatest(lr * 0.5, 0.0) ELSE lr END AS lr
      FROM (SELECT r.run, h.epoch, r.lr,
                   CASE WHEN h.val_loss < r.best * 0.9999::DOUBLE THEN h.val_loss ELSE r.best END AS best2,
                   CASE WHEN h.val_loss < r.best * 0.9999::DOUBLE THEN 0 ELSE r.bad + 1 END AS bad1
            FROM r JOIN h ON h.run = r.run AND h.epoch = r.epoch + 1) x)
SELECT run, epoch, lr FROM r WHERE epoch >= 1
""")
def history_plateau(spark, sf_dir):
    return hi.plateau_lr(_history(Tables(spark, sf_dir)), lr0=2e-3, factor=0.5, patience=2)


@register("batch_loss", sql=f"""
WITH e AS (SELECT vec_id, 0 AS epoch FROM embeddings),
r AS (SELECT epoch, vec_id, row_number() OVER (PARTITION BY epoch ORDER BY {_EPOCH_H}, vec_id) - 1 AS rk,
             count(*) OVER (PARTITION BY epoch) AS n FROM e),
l AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding) AS row_loss
      FROM embeddings),
b AS (SELECT epoch, rk // 128 AS batch_id, avg(row_loss) AS batch_loss, count(*) AS m, any_value(n) AS n
      FROM r JOIN l USING (vec_id) WHERE rk // 128 < n // 128 GROUP BY 1, 2)
SELECT CAST(epoch AS INTEGER) AS epoch, count(*) AS n_batches, round(sum(batch_loss * m) / any_value(n), 9) AS train_loss
FROM b GROUP BY epoch
""")
def batch_loss(spark, sf_dir):
    emb = Tables(spark, sf_dir).embeddings
    n = emb.count()
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                     lambda acc, x: acc + x)
    losses = emb.select("vec_id", (sq / F.size("embedding")).alias("row_loss"))
    batches = sp.mini_batches(emb.select("vec_id"), "vec_id", 128, 1, 0)
    per_batch = batches.join(losses, "vec_id").groupBy("epoch", "batch_id").agg(
        F.avg("row_loss").alias("batch_loss"), F.count(F.lit(1)).alias("m"))
    # weighted by batch size, divided by the FULL dataset size (dropped rows included)
    return per_batch.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.round(F.sum(F.col("batch_loss") * F.col("m")) / F.lit(float(n)), 9).alias("train_loss"))
