"""Array / image / vector queries over embeddings (64 floats per row, viewed as 8x8 images)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import arrays as ar
from tessera.operators import retrieval as rv
from tessera.operators.features import lookup
from tessera.operators.splits import sql_hash as H
from tessera.plans.registry import register
from tessera.sources.tables import Tables

SIDE = 8
NOISE_SEED = 11
FLIP_SEED = 3
TWO_PI = "6.283185307179586"

_DBL = "list_transform(embedding, lambda x: x::DOUBLE)"
_PIX_SQL = f"""
rg AS (SELECT min(list_min({_DBL})) AS lo, max(list_max({_DBL})) AS hi FROM embeddings),
px AS (SELECT vec_id, label,
              list_transform(embedding, lambda x: CAST(round((x::DOUBLE - lo) / (hi - lo) * 255) AS INTEGER)) AS pixels
       FROM embeddings, rg),
sc AS (SELECT vec_id, label, pixels, list_transform(pixels, lambda p: p::DOUBLE / 255.0::DOUBLE) AS scaled FROM px)"""


def _scaled(t):
    emb = t.embeddings
    lo, hi = ar.value_range(emb, "embedding")
    px = emb.select("vec_id", "label", ar.to_pixels("embedding", lo, hi).alias("pixels"))
    return px.withColumn("scaled", ar.scale_pixels("pixels"))


@register("array_scan", sql=f"""
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm
FROM embeddings
""")
def array_scan(spark, sf_dir):
    emb = Tables(spark, sf_dir).embeddings
    return emb.select("vec_id", "label", F.size("embedding").alias("dim"),
                      F.round(rv.l2_norm(F.col("embedding")), 9).alias("norm"))


@register("pixel_scale", sql=f"WITH {_PIX_SQL} SELECT vec_id, label, pixels, scaled FROM sc")
def pixel_scale(spark, sf_dir):
    return _scaled(Tables(spark, sf_dir))


@register("flatten", sql=f"""
WITH {_PIX_SQL},
im AS (SELECT vec_id, list_transform(range({SIDE}), lambda r: pixels[r * {SIDE} + 1 : r * {SIDE} + {SIDE}]) AS image FROM sc)
SELECT vec_id, image, flatten(image) AS flat FROM im
""")
def flatten(spark, sf_dir):
    s = _scaled(Tables(spark, sf_dir)).select("vec_id", ar.as_image("pixels", SIDE, SIDE).alias("image"))
    return s.withColumn("flat", ar.flatten_image("image"))


@register("hflip", sql=f"""
WITH {_PIX_SQL},
im AS (SELECT vec_id, list_transform(range({SIDE}), lambda r: pixels[r * {SIDE} + 1 : r * {SIDE} + {SIDE}]) AS image,
              {H('vec_id', FLIP_SEED)} % 2 = 1 AS flipped FROM sc)
SELECT vec_id, flipped,
       flatten(CASE WHEN flipped THEN list_transform(image, lambda row: list_reverse(row)) ELSE image END) AS flat
FROM im
""")
def hflip(spark, sf_dir):
    s = _scaled(Tables(spark, sf_dir)).select("vec_id", ar.as_image("pixels", SIDE, SIDE).alias("image"))
    flipped = ar.coin("vec_id", FLIP_SEED)
    img = F.when(flipped, ar.hflip("image")).otherwise(F.col("image"))
    return s.select("vec_id", flipped.alias("flipped"), ar.flatten_image(img).alias("flat"))


def _u(idx: str, seed: int) -> str:
    """SQL twin of the per-pixel uniform: (h(h(vec_id) XOR h(idx + 1)) + 0.5) / 2^32."""
    mixed = f"xor({H('vec_id', seed)}, {H(idx + ' + 1', seed)})"
    return f"(({H(mixed, seed)}) + 0.5) / 4294967296.0"


_NOISY_SQL = f"""
{_PIX_SQL},
nz AS (SELECT vec_id, label, scaled,
              list_transform(scaled, lambda x, i: greatest(0.0, least(1.0,
                  x + 0.3 * (sqrt(-2.0 * ln({_u('(i - 1)', NOISE_SEED)})) * cos({TWO_PI} * {_u('(i - 1)', NOISE_SEED + 1)}))
                    + x * 0.15 * (sqrt(-2.0 * ln({_u('(i - 1)', NOISE_SEED)})) * sin({TWO_PI} * {_u('(i - 1)', NOISE_SEED + 1)})))))
                  AS noisy
       FROM sc)"""


def _noisy(t):
    return _scaled(t).select("vec_id", "label", "scaled",
                             ar.corrupt("scaled", "vec_id", 0.30, 0.15, NOISE_SEED).alias("noisy"))


@register("corrupt", sql=f"""
WITH {_NOISY_SQL}
SELECT vec_id, list_transform(noisy, lambda y: round(y, 9)) AS noisy FROM nz
""")
def corrupt(spark, sf_dir):
    n = _noisy(Tables(spark, sf_dir))
    return n.select("vec_id", F.transform("noisy", lambda y: F.round(y, 9)).alias("noisy"))


_LOSS_SQL = f"""
{_NOISY_SQL},
ls AS (SELECT vec_id, list_sum(list_transform(range(len(scaled)), lambda i: pow(scaled[i + 1] - noisy[i + 1], 2)))
                          / len(scaled) AS mse,
              list_sum(list_transform(range(len(scaled)), lambda i: abs(scaled[i + 1] - noisy[i + 1]))) / len(scaled) AS l1
       FROM nz)"""


@register("recon_loss", sql=f"""
WITH {_LOSS_SQL}
SELECT vec_id, round(mse, 9) AS mse, round(l1, 9) AS l1, round(0.8 * mse + 0.2 * l1, 9) AS loss FROM ls
""")
def recon_loss(spark, sf_dir):
    n = _noisy(Tables(spark, sf_dir))
    return n.select("vec_id", F.round(ar.mse("scaled", "noisy"), 9).alias("mse"),
                    F.round(ar.l1("scaled", "noisy"), 9).alias("l1"),
                    F.round(ar.recon_loss("scaled", "noisy"), 9).alias("loss"))


@register("psnr", sql=f"""
WITH {_LOSS_SQL}
SELECT vec_id, CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE round(10.0 * log10(1.0 / mse), 6) END AS psnr FROM ls
""")
def psnr(spark, sf_dir):
    n = _noisy(Tables(spark, sf_dir))
    return n.select("vec_id", F.round(ar.psnr(ar.mse("scaled", "noisy")), 6).alias("psnr"))


_CENTROID_SQL = """
cells AS (SELECT label, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x,
                 unnest(range(len(embedding))) AS i FROM embeddings),
cen AS (SELECT label, list(m ORDER BY i) AS centroid
        FROM (SELECT label, i, avg(x) AS m FROM cells GROUP BY label, i) GROUP BY label)"""


def _centroids(t):
    return rv.centroids(t.embeddings, "label", "embedding")


@register("cosine_topk", sql=f"""
WITH {_CENTROID_SQL},
s AS (SELECT c.label, e.vec_id,
             round(list_dot_product(list_transform(e.embedding, lambda x: x::DOUBLE), c.centroid)
                   / ((sqrt(list_dot_product(list_transform(e.embedding, lambda x: x::DOUBLE),
                                             list_transform(e.embedding, lambda x: x::DOUBLE))) + 1e-10)
                      * (sqrt(list_dot_product(c.centroid, c.centroid)) + 1e-10)), 9) AS score
      FROM cen c, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def cosine_topk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rv.dense_topk(t.embeddings, _centroids(t), "vec_id", "embedding", "label", "centroid", 3)


@register("cluster_profile", sql="""
SELECT label, CAST(i AS INTEGER) AS dim, count(*) AS n, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean
FROM (SELECT label, embedding, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i
""")
def cluster_profile(spark, sf_dir):
    """Mean of every dimension per cluster, one row per (cluster, dimension)."""
    cells = Tables(spark, sf_dir).embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    return cells.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"),
                                             F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@register("inertia", sql=f"""
WITH {_CENTROID_SQL}
SELECT label, count(*) AS n,
       round(sum(list_sum(list_transform(range(len(e.embedding)),
                                          lambda i: pow(e.embedding[i + 1]::DOUBLE - c.centroid[i + 1], 2)))), 6) AS inertia
FROM embeddings e JOIN cen c USING (label) GROUP BY label
""")
def inertia(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cen = _centroids(t)
    joined = lookup(t.embeddings, cen, "label")
    d2 = F.aggregate(F.zip_with(ar.as_double("embedding"), F.col("centroid"), lambda a, b: (a - b) * (a - b)),
                     F.lit(0.0), lambda s, v: s + v)
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(d2), 6).alias("inertia"))


@register("argmax", sql="""
SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax
FROM embeddings
""")
def argmax(spark, sf_dir):
    """Index of the largest score in each row (first one on ties)."""
    emb = Tables(spark, sf_dir).embeddings
    return emb.select("vec_id", "label",
                      (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("argmax"))
