"""Training-history analytics: new-best flags, early stopping, plateau learning rate.

A history is one row per (run, epoch). Histories are small per run (epochs,
not data), so per-run windows and per-run ordered folds are cheap; the number
of runs can be large and is spread over partitions by ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_history(events: DataFrame, run_col: str, ts_col: str, value_col: str,
                  digits: int = 9) -> DataFrame:
    """Turn an event stream into a history: epoch = day number within the run, val = daily mean."""
    daily = (events.where(F.col(ts_col).isNotNull())
             .groupBy(F.col(run_col).alias("run"), F.to_date(ts_col).alias("day"))
             .agg(F.round(F.avg(value_col), digits).alias("val_loss")))
    w = Window.partitionBy("run").orderBy("day")
    return daily.withColumn("epoch", F.row_number().over(w).cast("int"))


def new_best(history: DataFrame, metric: str = "val_loss") -> DataFrame:
    """``is_best``: strictly below every earlier value of the run (the first epoch is a best)."""
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.min(metric).over(w)
    return history.withColumn("is_best", prior.isNull() | (F.col(metric) < prior))


def early_stop(history: DataFrame, patience: int = 3, metric: str = "val_loss") -> DataFrame:
    """Per run: epoch at which training stops (``patience`` epochs without a strict
    improvement; the last epoch when that never happens), and the best epoch up to it."""
    flagged = new_best(history, metric)
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    last_best = F.max(F.when(F.col("is_best"), F.col("epoch"))).over(w)
    waited = flagged.withColumn("wait", F.col("epoch") - last_best)
    per_run = waited.groupBy("run").agg(
        F.min(F.when(F.col("wait") >= patience, F.col("epoch"))).alias("trigger"),
        F.max("epoch").alias("last_epoch"),
    )
    stops = per_run.select("run", F.coalesce("trigger", "last_epoch").alias("stop_epoch"),
                           F.col("trigger").isNotNull().alias("stopped_early"))
    upto = history.join(stops, "run").where(F.col("epoch") <= F.col("stop_epoch"))
    return upto.groupBy("run", "stop_epoch", "stopped_early").agg(
        F.min_by("epoch", F.struct(F.col(metric), F.col("epoch"))).alias("best_epoch"),
        F.min(metric).alias("best_val"),
    )


def plateau_lr(history: DataFrame, lr0: float = 2e-3, factor: float = 0.5, patience: int = 2,
               threshold: float = 1e-4, min_lr: float = 0.0, eps: float = 1e-8,
               metric: str = "val_loss") -> DataFrame:
    """Learning rate after each epoch under reduce-on-plateau (mode min, relative threshold).

    The scheduler is a sequential fold, so each run's (small) history is
    gathered in epoch order and folded with ``aggregate`` -- a JVM-side loop,
    no Python. State = (best, bad epochs, lr, lr per epoch).
    """
    runs = history.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("epoch", F.col(metric).alias("v")))).alias("h"))
    init = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(lr0).alias("lr"),
        F.array().cast("array<struct<epoch:int,lr:double>>").alias("out"),
    )

    def step(st, e):
        better = e["v"] < st["best"] * F.lit(1.0 - threshold)
        best = F.when(better, e["v"]).otherwise(st["best"])
        bad = F.when(better, F.lit(0)).otherwise(st["bad"] + 1)
        cut = bad > patience
        new_lr = F.greatest(st["lr"] * F.lit(factor), F.lit(min_lr))
        lr = F.when(cut & ((st["lr"] - new_lr) > F.lit(eps)), new_lr).otherwise(st["lr"])
        bad = F.when(cut, F.lit(0)).otherwise(bad)
        rec = F.struct(e["epoch"].cast("int").alias("epoch"), lr.alias("lr"))
        return F.struct(best.alias("best"), bad.alias("bad"), lr.alias("lr"),
                        F.concat(st["out"], F.array(rec)).alias("out"))

    folded = runs.select("run", F.aggregate("h", init, step)["out"].alias("out"))
    return folded.select("run", F.inline("out"))
