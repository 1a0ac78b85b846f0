"""Table profiling: head, column info, describe, null counts, duplicates, shape.

Every profile is ONE aggregate over the table (so one scan and one tiny
shuffle of partial results), reshaped afterwards with ``inline`` over an
array of structs. Nothing per-column launches its own job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def head(df: DataFrame, order_cols: Sequence[str | Column], n: int = 5) -> DataFrame:
    """First ``n`` rows in an explicit order (Spark plans a TakeOrdered: top-n per partition)."""
    return df.orderBy(*order_cols).limit(n)


def column_info(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, non_null_count) for every column."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"c{i}").alias("non_null_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int | None = 6) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max per column.

    Quantiles are exact, from two scans of all columns and the few values between brackets; see ``bracket_quantiles``.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    one = df.agg(*aggs)
    quantiles = bracket_quantiles(df, [], cols, (0.25, 0.5, 0.75)).groupBy("col").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)])

    def r(col: Column) -> Column:
        return F.round(col, digits) if digits is not None else col

    rows = [
        F.struct(
            F.lit(i).alias("__i"),
            F.lit(c).alias("column_name"),
            F.col(f"n{i}").alias("count"),
            r(F.col(f"mean{i}")).alias("mean"),
            r(F.col(f"std{i}")).alias("std"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
        )
        for i, c in enumerate(cols)
    ]
    moments = one.select(F.inline(F.array(*rows)))
    # a row per column on either side
    return moments.join(F.broadcast(quantiles), F.col("column_name") == F.col("col"), "left").select(
        "column_name", "count", "mean", "std", "min", r(F.col("p25")).alias("p25"), r(F.col("p50")).alias("p50"),
        r(F.col("p75")).alias("p75"), "max")


def null_counts(df: DataFrame, table_name: str | None = None) -> DataFrame:
    """(table_name, column_name, null_count) -- ``isnull().sum()`` per column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(table_name).alias("table_name"), F.lit(c).alias("column_name"),
                 F.col(f"c{i}").alias("null_count"))
        for i, c in enumerate(df.columns)
    ]
    return one.select(F.inline(F.array(*rows)))


def dup_flags(df: DataFrame, key_cols: Sequence[str], id_col: str, out: str = "is_dup") -> DataFrame:
    """True on the 2nd+ occurrence (in ``id_col`` order) of identical ``key_cols``.

    Not a window partitioned by the key (a hot key would land in one task):
    the first id per key comes from a partially aggregated group-by and is
    joined back; AQE splits a skewed key on the large side of that join.
    Nulls compare equal, as in pandas ``duplicated``.
    """
    first = df.groupBy(*key_cols).agg(F.min(id_col).alias("__first"))
    cond = [df[c].eqNullSafe(first[c]) for c in key_cols]
    return (
        df.join(first, cond, "inner")
        .select(df[id_col], (df[id_col] != F.col("__first")).alias(out))
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """Rows per distinct value (null included as its own value), most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), col)


def class_shares(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """value_counts(normalize=True): (value, n, share); the total is a window over the tiny result."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(_whole())
    return counts.withColumn("share", F.round(F.col("n") / total, digits))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def distinct_excluding(df: DataFrame, col: str, exclude_value, by: str | None = None,
                       out: str = "n_distinct") -> DataFrame:
    """Number of distinct values of ``col`` other than ``exclude_value`` (e.g. noise = -1)."""
    kept = F.when(F.col(col) != F.lit(exclude_value), F.col(col))
    agg = F.count_distinct(kept).alias(out)
    return df.groupBy(by).agg(agg) if by else df.agg(agg)


def safe_ratio(num: Column | str, den: Column | str, scale: float = 1.0,
               digits: int | None = None, half_even: bool = True) -> Column:
    """num / den * scale with NULL (not an ANSI error) when den = 0.

    numpy rounds half to even, so ``half_even`` uses ``bround``.
    """
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    v = F.try_divide(num, den)
    if scale != 1.0:
        v = v * F.lit(scale)
    if digits is not None:
        v = F.bround(v, digits) if half_even else F.round(v, digits)
    return v


#: Size of a sketch (its rank error is about 0.05 %) and the margin taken around a rank; what a sketch for a second
#: round is worth; brackets with more values than ``KEEP`` have one.
SKETCH, MARGIN = 8000, 0.001
ACCURACY = 10_000
KEEP = 1_000_000
GRID = 200


def bracket_quantiles(df: DataFrame, group_cols: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of ``cols`` in every group: (*group_cols, col, prob, value), nulls left out.

    1. A mergeable sketch per group and column (KLL, one scan) gives two values that very likely enclose each wanted rank.
    2. A second scan counts the values below, strictly inside and up to these brackets. A bracket of one value is settled;
       one that misses its rank or has very many values strictly inside is drawn again from a sketch of its own rows.
       What repeats at the ends of a bracket does not count, so a round leaves few of these values, however often they repeat.
    3. The values of the other brackets, counted by value, are the only ones that are shuffled.

    Groups are joined to the rows by a broadcast measured to be small, else as Spark chooses. No group is gathered.
    """
    from tessera.operators.ordering import broadcast_if_small
    from tessera.session import stored

    gs = [f"__g{i}" for i in range(len(group_cols))]
    vs = [f"__v{i}" for i in range(len(cols))]
    slots = [(i, float(p)) for i in range(len(cols)) for p in probs]
    values = df.select(*[F.col(c).alias(g) for c, g in zip(group_cols, gs)], *[F.col(c).cast("double").alias(v) for c, v in zip(cols, vs)])

    def grouped(rows: DataFrame, aggs: list[str]) -> DataFrame:
        exprs = [F.expr(a) for a in aggs]
        return rows.groupBy(*gs).agg(*exprs) if gs else rows.agg(*exprs)

    def joined(rows: DataFrame, marks: DataFrame) -> DataFrame:
        """The rows with what ``marks`` (stored) says of their group; of all rows if there are no groups."""
        if not gs:
            row = marks.first()
            return rows.selectExpr("*", *[f"{_literal(row[f.name], f.dataType)} AS {f.name}" for f in marks.schema.fields])
        named = broadcast_if_small(marks.withColumnsRenamed({g: f"__m{g}" for g in gs}))
        return rows.join(named, F.expr(" AND ".join(f"{g} <=> __m{g}" for g in gs))).drop(*[f"__m{g}" for g in gs])

    def counted(marks: DataFrame) -> DataFrame:
        """The marks with, per slot, values below (b) and up to (u) the bracket, strictly inside (w), and the next value beyond it (x)."""
        aggs = [a for s, (i, _) in enumerate(slots) for a in (
            f"count(IF({vs[i]} < lo{s}, 1, NULL)) AS b{s}", f"count(IF({vs[i]} <= hi{s}, 1, NULL)) AS u{s}",
            f"count(IF({vs[i]} > lo{s} AND {vs[i]} < hi{s}, 1, NULL)) AS w{s}", f"min(IF({vs[i]} > hi{s}, {vs[i]}, NULL)) AS x{s}")]
        met = joined(values, marks)
        for start in range(0, len(aggs), 36):  # an aggregate of more fields would not be compiled
            marks = joined(marks, grouped(met, aggs[start : start + 36]))
        return stored(marks, "quantile-marks")

    wanted = ", ".join(f"{min(1.0, max(0.0, p + d))!r}D" for p in probs for d in (-MARGIN, MARGIN))
    sketches = grouped(values, [a for i, v in enumerate(vs) for a in (
        f"count({v}) AS n{i}", f"count(IF(isnan({v}), NULL, {v})) AS m{i}", f"kll_sketch_agg_double({v}, {SKETCH}) AS k{i}")])
    of_slot = [*gs, *[f"{c}{i}" for c in "nm" for i in range(len(vs))]]
    drawn = sketches.selectExpr(*of_slot, *[
        f"IF(kll_sketch_get_n_double(k{i}) > 0, kll_sketch_get_quantile_double(k{i}, array({wanted})), NULL) AS q{i}" for i in range(len(vs))])
    place = {s: (i, 2 * (s % len(probs))) for s, (i, _) in enumerate(slots)}
    marks = counted(stored(drawn.selectExpr(*of_slot, *[f"q{i}[{at + d}] AS {side}{s}" for s, (i, at) in place.items()
                                                        for d, side in enumerate(("lo", "hi"))]), "quantile-sketch"))
    low = {s: f"floor({p!r}D * (n{i} - 1))" for s, (i, p) in enumerate(slots)}
    # the value beyond a bracket is that of rank u alone: a rank of u and a half lies between two values that are not held
    missed = {s: f"(n{i} > 0 AND (lo{s} IS NULL OR {low[s]} < b{s} OR (ceil({p!r}D * (n{i} - 1)) > u{s} AND NOT isnan(x{s}))))"
              for s, (i, p) in enumerate(slots)}
    again = {s: f"({missed[s]} OR (lo{s} < hi{s} AND w{s} > {KEEP}))" for s in missed}
    while True:
        state = marks.agg(*[F.expr(f"coalesce(max({again[s]}), false) AS s{s}") for s in again]).first()
        todo = [s for s in again if state[f"s{s}"]]
        if not todo:
            break
        # a bracket that misses its rank takes in all values, one that holds too many is cut down
        opened = marks.selectExpr(*of_slot, *[e for s in again for e in (
            f"IF({missed[s]}, CAST('-Infinity' AS DOUBLE), lo{s}) AS lo{s}", f"IF({missed[s]}, CAST('Infinity' AS DOUBLE), hi{s}) AS hi{s}",
            f"IF({missed[s]}, 0, b{s}) AS b{s}", f"IF({missed[s]}, m{slots[s][0]}, u{s}) - IF({missed[s]}, 0, b{s}) AS size{s}",
            f"{again[s]} AS again{s}")])
        opened = stored(opened, "quantile-open")
        grid = "array(" + ", ".join(f"{k / GRID!r}D" for k in range(GRID + 1)) + ")"
        fine = stored(grouped(joined(values, opened), [
            f"percentile_approx(IF({vs[slots[s][0]]} BETWEEN lo{s} AND hi{s}, {vs[slots[s][0]]}, NULL), {grid}, {ACCURACY}) AS f{s}"
            for s in todo]), "quantile-grid")
        at = {s: f"floor(({low[s]} - b{s}) / greatest(size{s}, 1) * {GRID})" for s in todo}
        cut = {(s, side): f"IF(again{s}, get(f{s}, CAST({k} AS INT)), {side}{s})" for s in todo
               for side, k in (("lo", f"greatest({at[s]} - 1, 0)"), ("hi", f"least({at[s]} + 3, {GRID})"))}
        marks = counted(stored(joined(opened, fine).selectExpr(*of_slot, *[
            f"{cut.get((s, side), side + str(s))} AS {side}{s}" for s in again for side in ("lo", "hi")]), "quantile-sketch"))

    inside = {s: f"({vs[i]} >= lo{s} AND {vs[i]} <= hi{s} AND lo{s} < hi{s})" for s, (i, _) in enumerate(slots)}
    cells = ", ".join(f"IF({c}, struct({s} AS slot, {vs[slots[s][0]]} AS v), NULL)" for s, c in inside.items())
    held = joined(values, marks).where(" OR ".join(inside.values())).selectExpr(
        *gs, f"inline(filter(array({cells}), c -> c IS NOT NULL))").groupBy(*gs, "slot", "v").agg(F.count(F.lit(1)).alias("n"))
    over = f"(PARTITION BY {', '.join([*gs, 'slot'])} ORDER BY v)"  # at most KEEP values
    held = held.selectExpr(*[f"{g} AS __h{g}" for g in gs], "slot AS __slot", "v", "n", f"sum(n) OVER {over} AS upto")
    rows = ", ".join(f"struct({s} AS slot, {i} AS i, {p!r}D AS prob, n{i} AS total, lo{s} AS lo, hi{s} AS hi, b{s} AS b, u{s} AS u, x{s} AS x)"
                     for s, (i, p) in enumerate(slots))
    asked = marks.selectExpr(*gs, f"inline(array({rows}))")
    ends = asked.join(held, F.expr(" AND ".join(["slot = __slot", *[f"{g} <=> __h{g}" for g in gs]])), "left")

    def at_rank(r: str) -> str:
        return (f"max(CASE WHEN {r} >= u THEN x WHEN lo = hi THEN lo WHEN {r} >= b + upto - n AND {r} < b + upto THEN v END)")

    place_of = "(prob * (total - 1))"
    got = ends.groupBy(*gs, "i", "prob", "total").agg(
        F.expr(f"{at_rank(f'floor{place_of}')} AS low"), F.expr(f"{at_rank(f'ceil{place_of}')} AS high"))
    names = "array(" + ", ".join("'" + c.replace("'", "\\'") + "'" for c in cols) + ")"
    return got.selectExpr(*[f"{g} AS `{c}`" for g, c in zip(gs, group_cols)], f"{names}[i] AS col", "prob",
                          f"IF(low = high, low, low + ({place_of} - floor{place_of}) * (high - low)) AS value")


def _literal(value, kind) -> str:
    """A value of a row in SQL."""
    if value is None:
        return f"CAST(NULL AS {kind.simpleString()})"
    if kind.typeName() == "array":
        return "array(" + ", ".join(_literal(v, kind.elementType) for v in value) + ")"
    return f"CAST('{'NaN' if value != value else repr(value)}' AS {kind.simpleString()})"


def grouped_quantiles(df: DataFrame, group_cols: Sequence[str], value: str, probs: Sequence[float],
                      names: Sequence[str]) -> DataFrame:
    """Exact quantiles of every group that has a value: (*group_cols, *names); see ``bracket_quantiles``."""
    found = bracket_quantiles(df.where(F.col(value).isNotNull()), group_cols, [value], probs)
    return found.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(name) for p, name in zip(probs, names)])


def exact_quantiles(df: DataFrame, col: str, probs=(0.25, 0.5, 0.75)) -> dict[float, float | None]:
    """Exact quantiles of one column, None where it has no value."""
    names = [f"q{i}" for i in range(len(probs))]
    row = grouped_quantiles(df.select(F.lit(0).alias("__all"), col), ["__all"], col, probs, names).first()
    return {p: row[n] if row else None for p, n in zip(probs, names)}
