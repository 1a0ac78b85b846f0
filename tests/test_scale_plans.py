"""Plan-shape and skew checks for the scale design (see README, "Scale design")."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import profile as pf
from tessera.operators import splits as sp
from tests.conftest import SMOKE_DIR


def _plan(df, capsys):
    df.explain(mode="formatted")
    return capsys.readouterr().out


def test_topk_queries_limit_before_shuffle(spark, capsys):
    from tessera.operators.retrieval import top_k

    plan = _plan(entry.queries()["attempt_summary"](spark, SMOKE_DIR), capsys)
    assert plan.count("WindowGroupLimit") >= 2  # partial limit below the exchange + final
    scores = spark.range(10000).select((F.col("id") % 7).alias("q"), F.col("id").alias("d"),
                                       (F.col("id") % 13).cast("double").alias("score"))
    plan = _plan(top_k(scores, ["q"], ["d"], 3), capsys)
    assert plan.count("WindowGroupLimit") >= 2


def test_scans_read_only_needed_columns(spark, capsys):
    q = entry.queries()
    plan = _plan(q["hash_split"](spark, SMOKE_DIR), capsys)
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    plan = _plan(q["shape"](spark, SMOKE_DIR), capsys)
    assert "ReadSchema: struct<>" in plan


def test_ordering_operators_avoid_single_partition(spark, capsys):
    q = entry.queries()
    for key in ("exact_split", "validation_tail", "vocabulary", "stratified_split", "mini_batches"):
        plan = _plan(q[key](spark, SMOKE_DIR), capsys)
        assert "SinglePartition" not in plan, key


def test_hot_key_results_stay_exact(spark):
    # one key holds a third of all rows
    n = 3000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot"))
                               .otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"),
                               (F.col("id") % 2).cast("int").alias("y"))
    flags = pf.dup_flags(df, ["key"], "id").where("NOT is_dup").count()
    assert flags == df.select("key").distinct().count()
    split = sp.stratified_split(df.withColumn("hot", (F.col("key") == "hot").cast("int")), "hot", "id", 0.8)
    sizes = {(r["hot"], r["split"]): r["count"] for r in split.groupBy("hot", "split").count().collect()}
    assert sizes[(1, "train")] == 800 and sizes[(0, "train")] == 1600


def test_sort_based_quantiles_match_percentile(spark):
    import math
    import random
    rng = random.Random(9)
    rows = [(rng.choice([rng.random() * 100, 7.0, 7.0, None]),) for _ in range(2001)]
    df = spark.createDataFrame(rows, "x double")
    got = pf.exact_quantiles(df, "x")
    want = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first()["q"]
    for p, w in zip((0.25, 0.5, 0.75), want):
        assert math.isclose(got[p], w, rel_tol=1e-12, abs_tol=1e-12)


def test_describe_and_box_stats_gather_no_value_map(spark, capsys):
    q = entry.queries()
    for key in ("describe", "box_stats"):
        plan = _plan(q[key](spark, SMOKE_DIR), capsys)
        assert "percentile" not in plan.lower() and "collect_" not in plan, key


def test_grouped_quantiles(spark):
    import random
    from statistics import quantiles

    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), 0.5])) for g in ("a", "b", None) for _ in range(rng.randint(50, 200))]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    got = {r["g"]: (r["p25"], r["p50"], r["p75"]) for r in pf.grouped_quantiles(
        spark.createDataFrame(rows, "g string, x double"), ["g"], "x", (0.25, 0.5, 0.75), ("p25", "p50", "p75")).collect()}
    for g in ("a", "b", None):
        want = quantiles([x for k, x in rows if k == g], n=4, method="inclusive")
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[g], want))
    assert got["one"] == (3.0, 3.0, 3.0) and got["two"] == (1.25, 1.5, 1.75) and "none" not in got


def test_small_inputs_of_profile_operators(spark):
    df = spark.createDataFrame([(None, None)], "x double, g string")
    for frame, n in ((df, 0), (df.limit(0), 0)):
        r = pf.describe(frame, ["x"]).first()
        assert r["count"] == n and r["mean"] is None and r["p50"] is None
    r = pf.describe(spark.createDataFrame([(2.0,)], "x double")).first()
    assert (r["count"], r["p25"], r["p75"], r["std"]) == (1, 2.0, 2.0, None)


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    import pytest
    from tessera import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    assert session.is_local("local") and session.is_local("local[8]") and not session.is_local("local-cluster[2,1,1024]")


def test_broadcast_needs_few_rows_and_bytes(spark, capsys):
    from tessera.operators.ordering import broadcast_if_small

    small = spark.range(10).withColumn("t", F.lit("x" * 1000))
    big = spark.range(100).select(F.col("id").alias("id"))
    for df, hinted in ((broadcast_if_small(small), True), (broadcast_if_small(small, max_rows=5), False),
                       (broadcast_if_small(small, max_bytes=5000), False)):
        plan = big.join(df, "id")._jdf.queryExecution().logical().toString()
        assert ("broadcast" in plan.lower()) == hinted
