"""Global order without a single-partition window.

``row_number().over(Window.orderBy(...))`` with no partition key pulls every
row into one task. For the exact splits, batch numbering, vocabulary ids and
exact AUC we need a true global position, so we compute it the way a range
sort already lays the data out:

1. range-partition on the order key and sort inside each partition;
2. checkpoint into the shared folder, so both passes below see the very same
   partitions (and lineage is cut, which keeps retries cheap);
3. count (or sum) per partition -- one tiny row per partition -- and turn the
   totals into a table of offsets (as many rows as partitions, never bounded
   by the data), which is broadcast;
4. add the offset to the position inside the partition.

The number of partitions follows the number of rows, so that a partition of a
very large table still fits a task.

The order key must be a total order (callers append a unique id) so that the
result does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut_lineage

_PID = "__pid"


#: Rows a range partition is sized for.
ROWS_PER_PARTITION = 2_000_000
#: Text of a task that splits it into words: some hundred thousand of them, counted in memory.
TEXT_BYTES = 8 << 20


def partitions_for(df: DataFrame, rows: int | None = None) -> int:
    """At least the session's shuffle width, more where ``rows`` (counted if not given) need it."""
    n = df.count() if rows is None else rows
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_PARTITION))


def spread_texts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """The rows dealt by ``key``, with about ``TEXT_BYTES`` of text in a task where that takes more than the shuffle width."""
    size = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return df.repartition(partitions_for(df, size * ROWS_PER_PARTITION // TEXT_BYTES), key)


def _sorted_checkpoint(df: DataFrame, order_cols: Sequence[Column | str],
                       num_partitions: int | None, rows: int | None) -> DataFrame:
    n = num_partitions or partitions_for(df, rows)
    laid_out = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn(_PID, F.spark_partition_id())
    )
    return cut_lineage(laid_out)


def _with_offset(laid_out: DataFrame, totals: dict[int, int], out: str) -> DataFrame:
    """Add the sum of the totals of all earlier partitions; one row per partition is broadcast."""
    running, rows = 0, []
    for pid in sorted(totals):
        rows.append((pid, running))
        running += totals[pid]
    offsets = laid_out.sparkSession.createDataFrame(rows, f"{_PID} int, {out} long")
    return laid_out.join(F.broadcast(offsets), _PID)


def global_index(df: DataFrame, order_cols: Sequence[Column | str], name: str = "idx",
                 num_partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """Append a 0-based global position ``name`` in ``order_cols`` order; ``rows`` is the count, if known."""
    columns = df.columns
    laid_out = _sorted_checkpoint(df, order_cols, num_partitions, rows)
    local = F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33)
    placed = laid_out.withColumn("__at", local)
    counts = {r[_PID]: r["n"] for r in laid_out.groupBy(_PID).agg(F.count("*").alias("n")).collect()}
    found = _with_offset(placed, counts, "__before")
    return found.select(*columns, (F.col("__before") + F.col("__at")).cast("long").alias(name))


def prefix_sums(df: DataFrame, order_cols: Sequence[Column | str], value_cols: Sequence[str],
                prefix: str = "cum_", inclusive: bool = True,
                num_partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """Running totals of ``value_cols`` in global ``order_cols`` order.

    Adds ``prefix + c`` for each value column (inclusive of the current row
    unless ``inclusive=False``). The in-partition running sum is an Arrow
    batch cumsum; partitions never exchange rows.
    """
    laid_out = _sorted_checkpoint(df, order_cols, num_partitions, rows)
    totals_rows = laid_out.groupBy(_PID).agg(*[F.sum(c).alias(c) for c in value_cols]).collect()
    offsets: dict[int, dict[str, float]] = {}
    running = {c: 0 for c in value_cols}
    for row in sorted(totals_rows, key=lambda r: r[_PID]):
        offsets[row[_PID]] = dict(running)
        for c in value_cols:
            running[c] += row[c] or 0

    out_fields = list(laid_out.schema.fields)
    for c in value_cols:
        src = laid_out.schema[c].dataType
        kind = T.DoubleType() if isinstance(src, (T.DoubleType, T.FloatType, T.DecimalType)) else T.LongType()
        out_fields.append(T.StructField(prefix + c, kind, True))
    out_schema = T.StructType(out_fields)

    def running_totals(batches):
        carry: dict[str, float] | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            if carry is None:
                carry = dict(offsets.get(int(pdf[_PID].iloc[0]), {c: 0 for c in value_cols}))
            for c in value_cols:
                vals = pdf[c].fillna(0).to_numpy()
                cs = np.cumsum(vals) + carry[c]
                pdf[prefix + c] = cs if inclusive else cs - vals
                carry[c] = cs[-1] if len(cs) else carry[c]
            yield pdf

    return laid_out.mapInPandas(running_totals, out_schema).drop(_PID)


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                name: str = "rank_in_group", num_partitions: int | None = None,
                rows: int | None = None) -> DataFrame:
    """0-based rank inside each group, with no window partitioned by group.

    A group may hold a third of all rows; a per-group window would put it in
    one task. Instead the global index over ``(group, order)`` is shifted by
    the start offset of the group, which comes from a per-group count.
    """
    indexed = global_index(df, [*group_cols, *order_cols], "__gidx", num_partitions, rows)
    starts = indexed.groupBy(*group_cols).agg(F.min("__gidx").alias("__gstart"))
    starts = starts.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group_cols)], "__gstart")
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group_cols)]
    return indexed.join(broadcast_if_small(starts), same).select(
        *df.columns, (F.col("__gidx") - F.col("__gstart")).alias(name))


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``broadcast(df)`` after measuring that it has at most so many rows and bytes, else ``df`` itself.

    The measurement stops at ``max_rows + 1`` rows. Unhinted, Spark picks a shuffle join, which it splits
    where the key is skewed.
    """
    size = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            cell = F.octet_length(F.col(f"`{f.name}`"))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            cell = F.size(F.col(f"`{f.name}`")) * 16
        elif isinstance(kind, T.StructType):
            cell = F.octet_length(F.to_json(F.col(f"`{f.name}`")))
        else:
            cell = F.lit(8)
        size = size + F.coalesce(cell.cast("long"), F.lit(0))
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= max_rows and (seen["bytes"] or 0) <= max_bytes else df


__all__ = ["broadcast_if_small", "global_index", "partitions_for", "prefix_sums", "rank_within", "spread_texts"]
