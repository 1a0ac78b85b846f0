"""The aggregates behind charts (the drawing itself is not built).

Each function returns the small table a plotting tool would need, computed
with map-side partial aggregation so chart data over 100 TB costs one scan
plus a shuffle of partial counts. Scalars needed up front (min/max/std/n)
come from a one-row aggregate collected to the driver -- one row, not data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import broadcast_if_small
from tessera.operators.profile import grouped_quantiles


def _moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def bin_expr(col: str, lo: float, hi: float, bins: int):
    """Equal-width bin 0..bins-1 over [lo, hi]; the last bin is closed; constant column -> bin 0."""
    width = (hi - lo) / bins if hi is not None and lo is not None else 0.0
    x = F.col(col).cast("double")
    if not width:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 10, digits: int = 6) -> DataFrame:
    """(bin, lo, hi, count) for all ``bins`` bins, empty ones included."""
    lo, hi = _moments(df, [col])[col]
    spark = df.sparkSession
    width = ((hi - lo) / bins) if lo is not None else 0.0
    counts = (df.where(F.col(col).isNotNull())
              .groupBy(bin_expr(col, lo, hi, bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    lo_l = F.lit(lo).cast("double")
    return (
        grid.join(counts, "bin", "left")
        .select(
            "bin",
            F.round(lo_l + F.col("bin") * F.lit(width), digits).alias("lo"),
            F.round(lo_l + (F.col("bin") + 1) * F.lit(width), digits).alias("hi"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def bin_counts_2d(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Scatter data at scale: counts per (x bin, y bin) cell of the given widths."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.floor(F.col(x) / x_width).alias("x_bin"), F.floor(F.col(y) / y_width).alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def pie_shares(df: DataFrame, col: str, top: int = 30, digits: int = 1) -> DataFrame:
    """Top ``top`` values by count (ties by value) and their % of the KEPT total."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    kept = counts.orderBy(F.desc("count"), F.asc_nulls_last(col)).limit(top)
    return kept.withColumn(
        "pct", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()), digits)
    )


def box_stats(df: DataFrame, group: str, value: str, whisker: float = 1.5, digits: int = 6) -> DataFrame:
    """Per group: quartiles, whisker ends (last data point within 1.5 IQR), outlier count.

    Quartiles come from brackets (``profile.bracket_quantiles``); the fences, one row per group, are
    joined back to the rows (broadcast once measured to be small) and whiskers are conditional min/max,
    so no group is ever gathered in one task.
    """
    x = F.col(value).cast("double")
    quart = grouped_quantiles(df.select(group, x.alias("__v")), [group], "__v", (0.25, 0.5, 0.75),
                              ("q1", "median", "q3"))
    fenced = quart.withColumn("iqr", F.col("q3") - F.col("q1")).select(
        group, "q1", "median", "q3",
        (F.col("q1") - whisker * F.col("iqr")).alias("lo_fence"),
        (F.col("q3") + whisker * F.col("iqr")).alias("hi_fence"),
    )
    v = F.col("__v")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    return (
        df.select(group, x.alias("__v")).where(v.isNotNull())
        .join(broadcast_if_small(fenced), group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_lo"),
            F.max(F.when(inside, v)).alias("whisker_hi"),
            F.count_if(~inside).alias("n_outliers"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(group, *[F.round(c, digits).alias(c) for c in ("q1", "median", "q3")],
                "whisker_lo", "whisker_hi", "n_outliers", "n")
    )


def kde(df: DataFrame, col: str, grid_size: int = 200, cut: float = 3.0,
        digits: int = 12) -> DataFrame:
    """Gaussian KDE on a grid (Scott bandwidth n^(-1/5) * sample std, grid cut 3 bandwidths).

    Exact: every distinct value contributes to every grid point. The data is
    first reduced to (value, multiplicity); each distinct value then emits
    ``grid_size`` weighted kernel terms that are summed per grid point with
    map-side partial aggregation, so the shuffle is ``grid_size`` rows per
    partition regardless of data size.
    """
    x = F.col(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"),
                F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    n, sd, lo, hi = st["n"], st["sd"], st["lo"], st["hi"]
    if not n or sd is None or sd == 0:
        return df.sparkSession.createDataFrame([], "grid_idx int, x double, density double")
    bw = sd * n ** (-1.0 / 5.0)
    g_lo, g_hi = lo - cut * bw, hi + cut * bw
    step = (g_hi - g_lo) / (grid_size - 1)
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    distinct = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("m"))
    gx = F.lit(g_lo) + F.col("grid_idx") * F.lit(step)
    terms = (
        distinct.select("v", "m", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("grid_idx"))
        .select("grid_idx", (F.col("m") * F.exp(F.lit(-0.5) * F.pow((gx - F.col("v")) / F.lit(bw), 2))).alias("k"))
    )
    return (
        terms.groupBy("grid_idx").agg(F.sum("k").alias("s"))
        .select(F.col("grid_idx").cast("int").alias("grid_idx"), F.round(gx, 6).alias("x"),
                F.round(F.col("s") * F.lit(norm), digits).alias("density"))
    )


def pair_bins(df: DataFrame, cols: Sequence[str], hue: str, bins: int = 10) -> DataFrame:
    """Pair-plot data: for every column pair, counts per (hue, x bin, y bin).

    One scan: each row emits one number per pair (a fixed number set by the column list), which stands for the pair
    and both bins; it is counted with partial aggregation and taken apart afterwards.
    """
    mm = _moments(df, cols)
    b = {c: bin_expr(c, mm[c][0], mm[c][1], bins) for c in cols}
    staged = df.select(F.col(hue).alias("__hue"), *[b[c].alias(f"__b{i}") for i, c in enumerate(cols)])
    pairs = list(combinations(range(len(cols)), 2))
    codes = F.array(*[F.col(f"__b{i}") * bins + F.col(f"__b{j}") + k * bins * bins for k, (i, j) in enumerate(pairs)])
    counted = staged.select("__hue", F.explode(codes).alias("code")).where("code IS NOT NULL").groupBy("__hue", "code").agg(
        F.count(F.lit(1)).alias("count"))
    names = F.array(*[F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y")) for i, j in pairs])
    pair = F.element_at(names, F.floor(F.col("code") / (bins * bins)).cast("int") + 1)
    return counted.select(pair["x"].alias("x_col"), pair["y"].alias("y_col"), F.col("__hue").alias(hue),
                          F.floor(F.col("code") % (bins * bins) / bins).cast("int").alias("x_bin"),
                          (F.col("code") % bins).cast("int").alias("y_bin"), "count")


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6, pairs_per_pass: int = 15) -> DataFrame:
    """Pairwise Pearson correlation of ``cols`` as long rows (diagonal = 1).

    Each correlation keeps six buffer fields; beyond ~16 pairs one aggregate
    exceeds whole-stage codegen's field limit and runs interpreted, so the
    pairs are computed ``pairs_per_pass`` at a time (one scan per pass).
    """
    from functools import reduce

    pairs = list(combinations(range(len(cols)), 2))
    parts = []
    for start in range(0, len(pairs), pairs_per_pass):
        chunk = pairs[start:start + pairs_per_pass]
        one = df.agg(*[F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"r{i}_{j}")
                       for i, j in chunk])
        rows = []
        for i, j in chunk:
            val = F.round(F.col(f"r{i}_{j}"), digits)
            rows.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), val.alias("corr")))
            rows.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"), val.alias("corr")))
        parts.append(one.select(F.inline(F.array(*rows))))
    spark = df.sparkSession
    diag = spark.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, corr double")
    return reduce(DataFrame.unionByName, parts, diag)
