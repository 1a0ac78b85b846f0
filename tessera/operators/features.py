"""Feature preparation: checked broadcast lookups, label encoding, scaling, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import broadcast_if_small, global_index

def lookup(df: DataFrame, dim: DataFrame, on, how: str = "inner", **bounds) -> DataFrame:
    """Dimension lookup join; the dimension is broadcast once its rows and bytes are measured to be small."""
    return df.join(broadcast_if_small(dim, **bounds), on, how)


def label_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Sorted distinct non-null values of ``col`` numbered 0..k-1 (LabelEncoder order).

    The numbering is a range-sorted global index, so a high-cardinality
    column never funnels through one task.
    """
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    return global_index(distinct, [col], out).withColumn(out, F.col(out).cast("int"))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    out = out or f"{col}_enc"
    codes = label_codes(df, col, out)
    return lookup(df, codes, col, "left")


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and POPULATION std per column (sklearn ``StandardScaler``), one aggregate.

    MLlib's StandardScaler divides by the sample std, hence this estimator.
    A zero std scales by 1, as sklearn does.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def apply_standard_scaler(df: DataFrame, moments: dict[str, tuple[float, float]],
                          suffix: str = "_scaled", digits: int | None = None) -> DataFrame:
    out = df
    for c, (mean, sd) in moments.items():
        v = (F.col(c).cast("double") - F.lit(mean)) / F.lit(sd if sd else 1.0)
        out = out.withColumn(c + suffix, F.round(v, digits) if digits is not None else v)
    return out


def class_weights(df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """Balanced weights n / (k * n_c) per class plus the negative/positive ratio.

    The class table has one row per class; the window over it is tiny.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    n_total = F.sum("n").over(whole)
    k = F.count(F.lit(1)).over(whole)
    n_pos = F.sum(F.when(F.col(label) == 1, F.col("n"))).over(whole)
    n_neg = F.sum(F.when(F.col(label) == 0, F.col("n"))).over(whole)
    return counts.select(
        label, "n",
        F.round(n_total / (k * F.col("n")), digits).alias("weight"),
        F.round(F.try_divide(n_neg, n_pos), digits).alias("neg_pos_ratio"),
    )


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return lookup(df, w, label, "left")
