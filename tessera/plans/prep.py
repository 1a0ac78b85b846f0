"""Lookup joins, encodings, scaling, class weights, splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as fe
from tessera.operators import splits as sp
from tessera.plans.registry import register
from tessera.sources.tables import Tables

H = sp.sql_hash


@register("label_lookup", sql="""
SELECT c_custkey, n_name, r_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def label_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nation_region = fe.lookup(t.nation, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    dim = nation_region.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return fe.lookup(t.customer, dim, "c_nationkey").select("c_custkey", "n_name", "r_name")


@register("label_encode", sql="""
SELECT *, CASE WHEN c_mktsegment IS NOT NULL
               THEN CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) END AS c_mktsegment_enc
FROM customer
""")
def label_encode(spark, sf_dir):
    return fe.label_encode(Tables(spark, sf_dir).customer, "c_mktsegment")


@register("standard_scale", sql="""
SELECT l_orderkey, l_linenumber,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity_scaled,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6)
           AS l_extendedprice_scaled
FROM lineitem
""")
def standard_scale(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    moments = fe.fit_standard_scaler(li, ["l_quantity", "l_extendedprice"])
    return fe.apply_standard_scaler(li, moments, digits=6).drop("l_quantity", "l_extendedprice")


@register("class_balance_weight", sql="""
SELECT toxic, count(*) AS n,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight,
       round(sum(CASE WHEN toxic = 0 THEN count(*) END) OVER () / sum(CASE WHEN toxic = 1 THEN count(*) END) OVER (), 6)
           AS neg_pos_ratio
FROM labels WHERE toxic IS NOT NULL GROUP BY toxic
""")
def class_balance_weight(spark, sf_dir):
    return fe.class_weights(Tables(spark, sf_dir).labels, "toxic")


@register("hash_split", sql=f"""
SELECT o_orderkey, CASE WHEN {H('o_orderkey', 42)} / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS split
FROM orders
""")
def hash_split(spark, sf_dir):
    return sp.hash_split(Tables(spark, sf_dir).orders.select("o_orderkey"), "o_orderkey", 0.8, 42)


@register("stratified_split", sql=f"""
SELECT doc_id, quality, toxic,
       CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY {H('doc_id', 42)}, doc_id) - 1
                 < round(count(*) OVER (PARTITION BY toxic) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM labels
""")
def stratified_split(spark, sf_dir):
    return sp.stratified_split(Tables(spark, sf_dir).labels, "toxic", "doc_id", 0.8, 42)


@register("exact_split", sql=f"""
SELECT vec_id, label,
       CASE WHEN row_number() OVER (ORDER BY {H('vec_id', 7)}, vec_id) - 1 < floor(0.15 * count(*) OVER ())
            THEN 'val' ELSE 'train' END AS split
FROM embeddings
""")
def exact_split(spark, sf_dir):
    return sp.exact_split(Tables(spark, sf_dir).embeddings.select("vec_id", "label"), "vec_id", 0.15, 7)


@register("validation_tail", sql="""
SELECT vec_id, label,
       CASE WHEN row_number() OVER (ORDER BY vec_id) - 1 >= floor(count(*) OVER () * 0.9) THEN 'val' ELSE 'train' END
           AS split
FROM embeddings
""")
def validation_tail(spark, sf_dir):
    return sp.validation_tail(Tables(spark, sf_dir).embeddings.select("vec_id", "label"), "vec_id", 0.1)


_EPOCH_H = H(f"xor({H('vec_id', 0)}, {H('epoch + 1', 0)})", 0)


@register("mini_batches", sql=f"""
WITH e AS (SELECT vec_id, CAST(epoch AS INTEGER) AS epoch FROM embeddings, range(2) r(epoch)),
r AS (SELECT epoch, vec_id, row_number() OVER (PARTITION BY epoch ORDER BY {_EPOCH_H}, vec_id) - 1 AS rk,
             count(*) OVER (PARTITION BY epoch) AS n FROM e)
SELECT epoch, vec_id, rk // 128 AS batch_id, rk % 128 AS pos_in_batch FROM r WHERE rk // 128 < n // 128
""")
def mini_batches(spark, sf_dir):
    return sp.mini_batches(Tables(spark, sf_dir).embeddings.select("vec_id"), "vec_id", 128, 2, 0)
