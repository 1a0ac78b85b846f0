import tempfile

from pyspark.sql import functions as F

from tessera.sources import files as fs
from tessera.streaming import attempts as st
from tests.conftest import SMOKE_DIR


def test_stream_matches_batch_counts(spark):
    schema = spark.read.parquet(f"{SMOKE_DIR}/events.parquet").schema
    stream = st.read_event_stream(spark, SMOKE_DIR, schema, "events.parquet")
    out, ckpt = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp")
    q = st.run_available_now(st.windowed_attempts(stream, watermark="0 seconds"), out, ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = spark.read.parquet(f"{SMOKE_DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")) \
        .groupBy(F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("f"))
    # every window except the last (still open under the watermark) is emitted
    assert got.count() == batch.count() - 1
    joined = got.join(batch, got.window_start == batch.window.start)
    assert joined.where((F.col("attempts") != F.col("n")) | (F.col("failed") != F.col("f"))).count() == 0


def test_csv_roundtrip_and_listing(spark):
    df = spark.createDataFrame([(1, "a,b", 1.25), (2, None, -0.5)], "id int, s string, x double")
    path = fs.write_csv(df, tempfile.mkdtemp(dir="/tmp") + "/t")
    back = fs.read_csv(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    names = {r["file_name"] for r in fs.list_files(spark, SMOKE_DIR, "*.parquet").collect()}
    assert "lineitem.parquet" in names and len(names) == 14
