"""Joins under Zipf skew: same rows as a plain join, and no task much larger than the others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import skewjoin as sk
from tessera.operators import text as te


def _zipf(spark, n=120_000):
    rng = np.random.default_rng(5)
    word = np.minimum(rng.zipf(1.3, n), 40_000)
    return spark.createDataFrame([(i, f"w{w}") for i, w in enumerate(word.tolist())], "id long, token string").repartition(8, "id")


@pytest.fixture
def no_automatic_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_heavy_keys_are_those_beyond_the_share(spark):
    rows = _zipf(spark).cache()
    n = rows.count()
    counts = {r["token"]: r["count"] for r in rows.groupBy("token").count().collect()}
    want = {t for t, c in counts.items() if c > n * sk.HEAVY_PART / 8}
    assert want and want == set(sk.heavy_keys(rows, "token", 8))
    assert sk.heavy_keys(rows.limit(0), "token", 8) == []


def test_no_task_is_twice_the_median(spark, no_automatic_broadcast):
    rows = _zipf(spark).cache()
    vocab = rows.select("token").distinct().withColumn("token_id", F.xxhash64("token"))
    plain = rows.join(vocab, "token").withColumn("p", F.spark_partition_id()).groupBy("p").count().toPandas()["count"]
    split = sk.split_join(rows, vocab, "token", tasks=8)
    sizes = split.withColumn("p", F.spark_partition_id()).groupBy("p").count().toPandas()["count"]
    assert plain.max() > 2 * plain.median()
    assert sizes.sum() == 120_000 and sizes.max() < 2 * sizes.median()


def test_same_rows_as_a_plain_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)]
                                 + [(300 + i, f"w{i}") for i in range(50)], "id long, token string")
    table = spark.createDataFrame([("hot", 1)] + [(f"w{i}", i + 2) for i in range(0, 50, 2)] + [("other", 99)], "token string, n int")
    for how in ("inner", "left"):
        for df in (rows, rows.limit(0), rows.where("token is null"), rows.where("id >= 300")):
            want = sorted(map(str, df.join(table, "token", how).collect()))
            got = sk.split_join(df, table, "token", how, tasks=8)
            assert got.columns == df.join(table, "token", how).columns
            assert sorted(map(str, got.collect())) == want
    with pytest.raises(ValueError):
        sk.split_join(rows, table, "token", "right")


def test_id_sequences_use_it(spark, no_automatic_broadcast):
    lines = spark.createDataFrame([(1, "the cat the dog"), (2, "the"), (3, "")], "line long, text string")
    toks = te.tokens(lines, ["line"])
    vocab = te.vocabulary(toks, ["line", "pos"])
    got = {r["line"]: r["seq"] for r in te.id_sequences(toks, vocab, ["line"]).collect()}
    assert got == {1: [1, 2, 1, 3], 2: [1]}
