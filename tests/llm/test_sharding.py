"""Rendezvous sharding: the law by key, weights, slots, and the edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def _shard(key, weights):
    def score(s):
        u = (int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13
        return weights[s] / -math.log(u)
    return max(range(len(weights)), key=lambda s: (score(s), -s))


def _check(rows, docs, weights, added):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    slots = defaultdict(list)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == _shard(key, weights) and r.grown_shard == _shard(key, weights + added) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_law_slots_and_growth(spark):
    docs = [(i, f"text é {i % 7}", "x") for i in range(3000)] + [(None, None, "y"), (None, "", "z"), (5, "again", None), (5, "again", None)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, SCHEMA).repartition(5), [1.0] * 16).collect()
    _check(rows, docs, [1.0] * 16, [1.0])
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {16} and 100 < len(moved) < 270
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) < 1.5 * min(sizes.values())


def test_weights(spark):
    docs = [(i, "t", "x") for i in range(6000)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, SCHEMA), [1.0, 3.0, 0.0, 2.0], [0.5, 0.25]).collect()
    _check(rows, docs, [1.0, 3.0, 0.0, 2.0], [0.5, 0.25])
    sizes = Counter(r.shard for r in rows)
    assert sizes[2] == 0 and abs(sizes[1] / 3000 - 1) < 0.08 and abs(sizes[3] / 2000 - 1) < 0.08
    for bad in ([], [0.0], [-1.0, 2.0], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.shard_documents(spark.createDataFrame(docs[:1], SCHEMA), bad)


def test_one_frequent_id_is_spread_and_gapless(spark):
    docs = [(7, "same", "x")] * 2000 + [(i, "t" * (i % 50), "x") for i in range(1000)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    _check(sharding.shard_documents(df, [1.0] * 4).collect(), docs, [1.0] * 4, [1.0])


def test_empty_table_and_long_text(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), [1.0, 1.0]).collect() == []
    docs = [(1, "ü" * 2_000_000, None)]
    _check(sharding.shard_documents(spark.createDataFrame(docs, SCHEMA), [1.0, 1.0]).collect(), docs, [1.0, 1.0], [1.0])


def test_keys_of_several_columns_and_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "bc", 1), ("ab", "c", 2), (None, "abc", 3), ("a", "bc", 4)], "x string, y string, n int")
    got = {r.n: r.k for r in df.select("n", sharding.key_of("x", "y").alias("k")).collect()}
    assert got[1] == got[4] and len(set(got.values())) == 3
    path = str(tmp_path / "shards")
    sharding.write_shards(df, sharding.key_of("x", "y"), [1.0] * 3, path, rows_per_file=1)
    back = spark.read.parquet(path)
    assert {r.n: r.shard for r in back.collect()} == {n: _shard(k, [1.0] * 3) for n, k in got.items()}


def test_choosing_has_no_shuffle(spark):
    df = spark.range(100).withColumn("text", F.lit("x"))
    plan = sharding.assign(df, sharding.key_of("id"), [1.0] * 8, [1.0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
