"""Model evaluation as exact aggregates (no sampling, no binning).

Every metric is one aggregate over (label, prediction[, score]) rows, so it
scales with partial aggregation. Undefined ratios are 0, as sklearn's
``zero_division`` default reports them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import prefix_sums


def _zero_div(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def regression_metrics(df: DataFrame, label: str, pred: str, digits: int = 6) -> DataFrame:
    """MAE, RMSE and R^2 = 1 - SSE / SST in one pass."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    err = y - p
    one = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        F.count(F.lit(1)).alias("n"),
    )
    return one.select(
        "n",
        F.round("mae", digits).alias("mae"),
        F.round("rmse", digits).alias("rmse"),
        F.round(1 - F.try_divide(F.col("sse"), F.col("sst")), digits).alias("r2"),
    )


def confusion_matrix(df: DataFrame, actual: str, pred: str, classes: Sequence = (0, 1)) -> DataFrame:
    """Counts for every (actual, predicted) cell of the class grid, zeros included."""
    grid = df.sparkSession.createDataFrame(
        [(a, p) for a in classes for p in classes], f"{actual} int, predicted int")
    counts = df.groupBy(F.col(actual).cast("int").alias(actual), F.col(pred).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))
    return grid.join(counts, [actual, "predicted"], "left").select(
        actual, "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def _counts(df: DataFrame, actual: str, pred: str, positive) -> DataFrame:
    a, p = F.col(actual), F.col(pred)
    return df.agg(
        F.count_if((a == positive) & (p == positive)).alias("tp"),
        F.count_if((a != positive) & (p == positive)).alias("fp"),
        F.count_if((a == positive) & (p != positive)).alias("fn"),
        F.count_if(a == p).alias("correct"),
        F.count(F.lit(1)).alias("n"),
    )


def class_metrics(df: DataFrame, actual: str, pred: str, positive=1, digits: int = 6) -> DataFrame:
    """Accuracy, precision, recall and F1 for the positive class."""
    c = _counts(df, actual, pred, positive)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = _zero_div(tp, tp + fp)
    recall = _zero_div(tp, tp + fn)
    f1 = _zero_div(2 * tp, 2 * tp + fp + fn)
    return c.select(
        F.round(_zero_div(F.col("correct"), F.col("n")), digits).alias("accuracy"),
        F.round(precision, digits).alias("precision"),
        F.round(recall, digits).alias("recall"),
        F.round(f1, digits).alias("f1"),
    )


def class_report(df: DataFrame, actual: str, pred: str, classes: Sequence = (0, 1),
                 digits: int = 6) -> DataFrame:
    """Per-class precision/recall/F1/support, then accuracy, macro and weighted averages."""
    a, p = F.col(actual), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(a == p).alias("correct")]
    for i, c in enumerate(classes):
        aggs += [F.count_if((a == c) & (p == c)).alias(f"tp{i}"),
                 F.count_if(p == c).alias(f"pp{i}"),
                 F.count_if(a == c).alias(f"s{i}")]
    one = df.agg(*aggs)
    prec = [_zero_div(F.col(f"tp{i}"), F.col(f"pp{i}")) for i in range(len(classes))]
    rec = [_zero_div(F.col(f"tp{i}"), F.col(f"s{i}")) for i in range(len(classes))]
    f1 = [_zero_div(2 * F.col(f"tp{i}"), F.col(f"pp{i}") + F.col(f"s{i}")) for i in range(len(classes))]
    k = float(len(classes))
    total = F.col("n")

    def row(name, pr, rc, f, sup):
        r = (lambda x: F.round(x, digits) if x is not None else F.lit(None).cast("double"))
        return F.struct(F.lit(name).alias("class_label"), r(pr).alias("precision"), r(rc).alias("recall"),
                        r(f).alias("f1"), sup.cast("long").alias("support"))

    rows = [row(str(c), prec[i], rec[i], f1[i], F.col(f"s{i}")) for i, c in enumerate(classes)]
    rows.append(row("accuracy", None, None, _zero_div(F.col("correct"), total), total))
    rows.append(row("macro avg", reduce(lambda x, y: x + y, prec) / k, reduce(lambda x, y: x + y, rec) / k,
                    reduce(lambda x, y: x + y, f1) / k, total))
    wsum = (lambda xs: _zero_div(reduce(lambda x, y: x + y,
                                        [x * F.col(f"s{i}") for i, x in enumerate(xs)]), total))
    rows.append(row("weighted avg", wsum(prec), wsum(rec), wsum(f1), total))
    return one.select(F.inline(F.array(*rows)))


def roc_auc(df: DataFrame, label: str, score: str, positive=1, digits: int = 9) -> DataFrame:
    """Exact ROC AUC (ties count one half), i.e. the Mann-Whitney statistic.

    Rows are first reduced to (distinct score, #pos, #neg); the number of
    negatives below each score is a distributed prefix sum over the score
    order (``ordering.prefix_sums``), never a single-partition window.
    """
    by_score = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(F.count_if(F.col(label) == positive).alias("pos"),
             F.count_if(F.col(label) != positive).alias("neg"))
    )
    cum = prefix_sums(by_score, ["s"], ["neg"], prefix="below_", inclusive=False)
    one = cum.agg(
        F.sum(F.col("pos") * (F.col("below_neg") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("p"), F.sum("neg").alias("q"),
    )
    return one.select(
        F.col("p").alias("n_pos"), F.col("q").alias("n_neg"),
        F.round(F.try_divide(F.col("u"), F.col("p") * F.col("q")), digits).alias("auc"),
    )


def log_loss(df: DataFrame, label: str, p1: str, eps: float = 1e-7, digits: int = 9) -> DataFrame:
    """Mean -ln p(true class) with probabilities clamped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(p1).cast("double"), F.lit(eps)), F.lit(1 - eps))
    p_true = F.when(F.col(label) == 1, p).otherwise(1 - p)
    return df.where(F.col(label).isNotNull() & F.col(p1).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(-F.ln(p_true)), digits).alias("log_loss"))
