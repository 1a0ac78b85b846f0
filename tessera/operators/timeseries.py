"""Monthly series, lag / rolling features and ordered splits.

The heavy step is the group-by on (year, month): partial aggregation runs
map-side, so even a month holding a third of all rows ships one partial sum
per input partition. Windows then run on the aggregate, whose size is the
number of months per series -- bounded, not data-sized. With ``series_cols``
every window is partitioned by series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_totals(df: DataFrame, date_col: str, value_col: str, out: str = "total",
                   series_cols: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """Sum ``value_col`` per (series, year, month); null dates are dropped."""
    total = F.sum(value_col)
    if digits is not None:
        total = F.round(total, digits)
    return (
        df.where(F.col(date_col).isNotNull())
        .groupBy(*series_cols, F.year(date_col).alias("year"), F.month(date_col).alias("month"))
        .agg(total.alias(out))
        .withColumn("date", F.make_date("year", "month", F.lit(1)))
    )


def lag_features(series: DataFrame, value_col: str, order_col: str = "date",
                 lags: Sequence[int] = (1, 2, 3), roll: int = 3,
                 series_cols: Sequence[str] = (), leak_free: bool = False,
                 digits: int | None = 4) -> DataFrame:
    """Add ``lag_k`` columns and a full-window rolling mean ``rolling_<roll>``.

    The rolling mean includes the current row, as the reference does (so it
    leaks the target); ``leak_free=True`` uses the ``roll`` rows before it.
    Windows that are not full yield null, like a pandas rolling mean.
    """
    w = Window.partitionBy(*series_cols).orderBy(order_col)
    out = series
    for k in lags:
        out = out.withColumn(f"lag_{k}", F.lag(value_col, k).over(w))
    frame = w.rowsBetween(-roll, -1) if leak_free else w.rowsBetween(-(roll - 1), 0)
    mean = F.avg(value_col).over(frame)
    if digits is not None:
        mean = F.round(mean, digits)
    full = F.count(value_col).over(frame) == roll
    return out.withColumn(f"rolling_{roll}", F.when(full, mean))


def ordered_split(df: DataFrame, order_col: str, train_frac: float = 0.8,
                  series_cols: Sequence[str] = ()) -> DataFrame:
    """First floor(train_frac * n) rows (in order) are train, the rest test.

    Meant for aggregated series (one row per period); ``idx`` is 0-based.
    """
    w = Window.partitionBy(*series_cols).orderBy(order_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*series_cols))
    idx = (F.row_number().over(w) - 1).cast("long")
    return (
        df.withColumn("idx", idx)
        .withColumn("split", F.when(F.col("idx") < F.floor(n * F.lit(train_frac)), "train")
                    .otherwise("test"))
    )


def ts_features(df: DataFrame, date_col: str, value_col: str, series_cols: Sequence[str] = (),
                lags: Sequence[int] = (1, 2, 3), roll: int = 3) -> DataFrame:
    """Monthly totals -> lags + rolling mean -> drop incomplete rows -> idx."""
    monthly = monthly_totals(df, date_col, value_col, "total", series_cols)
    feats = lag_features(monthly, "total", "date", lags, roll, series_cols).dropna("any")
    w = Window.partitionBy(*series_cols).orderBy("date")
    return feats.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


def long_lag_features(df: DataFrame, series_col: str, order_cols: Sequence[str], value_col: str, lags: Sequence[int] = (1, 2, 3),
                      roll: int = 3, digits: int | None = 4, num_partitions: int | None = None) -> DataFrame:
    """``lag_features`` of raw rows, where one series may hold a large part of them: no series is one task.

    Rows are range-sorted by (series, order), which cuts a long series into several partitions. What a partition
    needs of its neighbours is a halo of the last rows before it, at most the longest lag or ``roll`` - 1: the tails of
    all partitions are collected (so many rows a partition, never more) and sent back. Rows without a series are a
    series of their own; ``order_cols`` must order a series totally. A window that is not full or holds a null is null.
    """
    import numpy as np
    import pandas as pd

    from tessera.operators.ordering import _PID, _sorted_checkpoint

    halo = max([*lags, roll - 1, 1])
    laid_out = _sorted_checkpoint(df, [series_col, *order_cols], num_partitions, None)
    kind = laid_out.schema[series_col].dataType.simpleString()

    def tail(frames):
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf])
            held = held.iloc[-halo:]
        if held is not None and len(held):
            yield held.assign(at=range(len(held)))

    narrow = laid_out.select(_PID, F.col(series_col).alias("s"), F.col(value_col).cast("double").alias("v"))
    tails = narrow.mapInPandas(tail, f"{_PID} int, s {kind}, v double, at int").toPandas().sort_values([_PID, "at"])
    before = {int(p): tails[tails[_PID] < p].iloc[-halo:][["s", "v"]] for p in tails[_PID].unique()}
    sent = df.sparkSession.sparkContext.broadcast(before)  # ``halo`` rows a partition
    names = [f"lag_{k}" for k in lags]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in laid_out.schema.fields],
                        *[f"{n} double" for n in [*names, f"rolling_{roll}"]]])

    def features(frames):
        held = None
        for pdf in frames:
            if pdf.empty:
                continue
            if held is None:
                held = sent.value[int(pdf[_PID].iloc[0])]
            own = pd.DataFrame({"s": pdf[series_col].to_numpy(), "v": pdf[value_col].astype(float).to_numpy()})
            both = pd.concat([held, own], ignore_index=True)
            v, first = both["v"].to_numpy(), len(held)
            series = pd.factorize(both["s"], use_na_sentinel=False)[0]

            def shifted(k):
                out = np.full(len(both), np.nan)
                if k < len(both):
                    same = series[k:] == series[: len(both) - k]
                    out[k:] = np.where(same, v[: len(both) - k], np.nan)
                return out

            columns = {n: shifted(k)[first:] for n, k in zip(names, lags)}
            total = v.copy()
            for k in range(1, roll):
                total = total + shifted(k)
            columns[f"rolling_{roll}"] = (total / roll)[first:]
            yield pdf.assign(**{n: pd.array(c, "Float64") for n, c in columns.items()})
            held = both.iloc[-halo:]

    out = laid_out.mapInPandas(features, schema)
    rolled = F.col(f"rolling_{roll}")
    return out.withColumn(f"rolling_{roll}", rolled if digits is None else F.round(rolled, digits)).drop(_PID)
