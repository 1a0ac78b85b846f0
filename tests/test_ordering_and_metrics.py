"""Distributed ordering helpers, splits and metrics against brute force."""

import math
import random

from pyspark.sql import functions as F

from tessera.operators import history as hi
from tessera.operators import metrics as me
from tessera.operators import splits as sp
from tessera.operators.ordering import global_index, prefix_sums, rank_within


def test_global_index_is_partitioning_independent(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int")
    expect = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    for parts in (1, 17):
        got = {r["id"]: r["idx"] for r in global_index(df.repartition(parts), ["k", "id"], "idx", 7).collect()}
        assert got == expect


def test_prefix_sums_and_rank_within(spark):
    rows = [(i, i % 3, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, g int, v double")
    got = {r["id"]: r["cum_v"] for r in prefix_sums(df, ["id"], ["v"]).collect()}
    assert got[99] == sum(range(100)) and got[0] == 0.0
    ranks = {r["id"]: r["r"] for r in rank_within(df, ["g"], ["id"], "r", 5).collect()}
    assert ranks[0] == 0 and ranks[3] == 1 and ranks[2] == 0 and ranks[98] == 32


def test_exact_and_stratified_split_sizes(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    ex = sp.exact_split(df, "id", 0.15, 7)
    assert ex.where("split = 'val'").count() == 150
    st = sp.stratified_split(df, "y", "id", 0.8, 42).groupBy("y", "split").count().collect()
    sizes = {(r["y"], r["split"]): r["count"] for r in st}
    assert sizes[(1, "train")] == 80 and sizes[(0, "train")] == 720
    mb = sp.mini_batches(df, "id", 128, 2, 0)
    assert mb.count() == 2 * 7 * 128
    assert mb.where("epoch = 0").select("id").distinct().count() == 896


def test_roc_auc_matches_pairwise(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 15))) for _ in range(300)]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, s double")
    got = me.roc_auc(df, "y", "s").first()["auc"]
    assert math.isclose(got, brute, abs_tol=1e-9)


def test_plateau_matches_scheduler_rules(spark):
    vals = [1.0, 0.9, 0.95, 0.96, 0.97, 0.8, 0.81, 0.82, 0.83, 0.84, 0.85, 0.86]
    hist = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(vals)], "run string, epoch int, val_loss double")
    got = [r["lr"] for r in hi.plateau_lr(hist, lr0=1.0, factor=0.5, patience=2).orderBy("epoch").collect()]
    best, bad, lr, expect = float("inf"), 0, 1.0, []
    for v in vals:
        if v < best * (1 - 1e-4):
            best, bad = v, 0
        else:
            bad += 1
        if bad > 2:
            lr, bad = max(lr * 0.5, 0.0), 0
        expect.append(lr)
    assert got == expect
    es = hi.early_stop(hist, 3).first()
    assert (es["stop_epoch"], es["best_epoch"], es["stopped_early"]) == (5, 2, True)


def test_class_report_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "a int, p int")
    cm = {(r["a"], r["predicted"]): r["count"] for r in me.confusion_matrix(df, "a", "p").collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    m = me.class_metrics(df, "a", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.6, 0.5, 0.5, 0.5)


def test_splits_and_batches_ignore_partitioning(spark):
    df = spark.range(1500).withColumn("y", (F.col("id") % 4 == 0).cast("int"))

    def snap(frame, cols):
        return sorted(tuple(r[c] for c in cols) for r in frame.collect())

    for parts in (1, 17):
        d = df.repartition(parts)
        assert snap(sp.hash_split(d, "id", 0.8, 42), ["id", "split"]) == \
            snap(sp.hash_split(df, "id", 0.8, 42), ["id", "split"])
        assert snap(sp.mini_batches(d, "id", 128, 2, 0), ["epoch", "id", "batch_id", "pos_in_batch"]) == \
            snap(sp.mini_batches(df, "id", 128, 2, 0), ["epoch", "id", "batch_id", "pos_in_batch"])
        assert snap(sp.stratified_split(d, "y", "id", 0.8, 42), ["id", "split"]) == \
            snap(sp.stratified_split(df, "y", "id", 0.8, 42), ["id", "split"])
