"""Profiling and chart-data queries over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chartdata as cd
from tessera.operators import profile as pf
from tessera.plans.registry import register
from tessera.sources.tables import TABLE_COLUMNS, TABLE_NAMES, Tables

LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("head", sql="SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def head(spark, sf_dir):
    return pf.head(Tables(spark, sf_dir).orders, ["o_orderkey"], 5)


_LI_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double",
             "string", "string", "timestamp_ntz"]
_COLINFO_SQL = (
    "WITH c AS (UNPIVOT (SELECT "
    + ", ".join(f"count({c}) AS {c}" for c in TABLE_COLUMNS["lineitem"])
    + " FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE non_null_count),\n"
    + "t(position, column_name, data_type) AS (VALUES "
    + ", ".join(f"({i}, '{c}', '{ty}')" for i, (c, ty) in enumerate(zip(TABLE_COLUMNS["lineitem"], _LI_TYPES)))
    + ")\nSELECT t.position, t.column_name, t.data_type, c.non_null_count FROM t JOIN c USING (column_name)"
)


@register("column_info", sql=_COLINFO_SQL)
def column_info(spark, sf_dir):
    return pf.column_info(Tables(spark, sf_dir).lineitem)


_DESCRIBE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINEITEM_NUMERIC]
_DESCRIBE_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}::DOUBLE), 6) AS mean,
       round(stddev_samp({c}::DOUBLE), 6) AS std, min({c}::DOUBLE) AS min,
       round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
       round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, max({c}::DOUBLE) AS max FROM lineitem"""
    for c in _DESCRIBE_COLS
)


@register("describe", sql=_DESCRIBE_SQL)
def describe(spark, sf_dir):
    return pf.describe(Tables(spark, sf_dir).lineitem, _DESCRIBE_COLS)


_NULLS_SQL = "\nUNION ALL\n".join(
    f"SELECT * FROM (UNPIVOT (SELECT "
    + ", ".join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}" for c in TABLE_COLUMNS[t])
    + f" FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE null_count) "
    f"CROSS JOIN (SELECT '{t}' AS table_name)"
    for t in TABLE_NAMES
)


@register("null_counts", sql=_NULLS_SQL)
def null_counts(spark, sf_dir):
    tabs = Tables(spark, sf_dir)
    parts = [pf.null_counts(getattr(tabs, t), t) for t in TABLE_NAMES]
    return reduce(DataFrame.unionByName, parts)


@register("dup_flags", sql="""
SELECT doc_id, row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) > 1 AS is_dup
FROM documents
""")
def dup_flags(spark, sf_dir):
    return pf.dup_flags(Tables(spark, sf_dir).documents, ["text", "lang", "source", "n_chars"], "doc_id")


@register("shape", sql="SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def shape(spark, sf_dir):
    return pf.shape(Tables(spark, sf_dir).lineitem)


@register("value_counts", sql="SELECT p_size, count(*) AS count FROM part GROUP BY p_size")
def value_counts(spark, sf_dir):
    return pf.value_counts(Tables(spark, sf_dir).part, "p_size")


@register("class_shares", sql="""
SELECT toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM labels WHERE toxic IS NOT NULL GROUP BY toxic
""")
def class_shares(spark, sf_dir):
    return pf.class_shares(Tables(spark, sf_dir).labels, "toxic")


@register("distinct_excl", sql="""
SELECT event_type, count(DISTINCT CASE WHEN user_id <> 0 THEN user_id END) AS n_distinct
FROM events GROUP BY event_type
""")
def distinct_excl(spark, sf_dir):
    # distinct users per event type, the id 0 playing the role of the noise label
    return pf.distinct_excluding(Tables(spark, sf_dir).events, "user_id", 0, by="event_type")


@register("derived_ratios", sql="""
SELECT l_orderkey, l_linenumber,
       round_even(l_discount / nullif(l_tax, 0) * 100, 2) AS discount_tax_pct,
       l_extendedprice - l_quantity AS price_gap,
       round_even(l_tax / nullif(l_discount, 0), 4) AS tax_per_discount
FROM lineitem
""")
def derived_ratios(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.select(
        "l_orderkey", "l_linenumber",
        pf.safe_ratio("l_discount", "l_tax", 100.0, 2).alias("discount_tax_pct"),
        (F.col("l_extendedprice") - F.col("l_quantity")).alias("price_gap"),
        pf.safe_ratio("l_tax", "l_discount", 1.0, 4).alias("tax_per_discount"),
    )


@register("histogram", sql="""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS count
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 10), 6) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / 10), 6) AS hi,
       coalesce(b.count, 0) AS count
FROM g CROSS JOIN s LEFT JOIN b USING (bin)
""")
def histogram(spark, sf_dir):
    return cd.histogram(Tables(spark, sf_dir).lineitem, "l_extendedprice", 10)


@register("scatter_bins", sql="""
SELECT floor(CAST(year(o_orderdate) AS INTEGER) / 1.0)::BIGINT AS x_bin, floor(o_totalprice / 50000.0)::BIGINT AS y_bin,
       count(*) AS count
FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1, 2
""")
def scatter_bins(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return cd.bin_counts_2d(o, "year", "o_totalprice", 1.0, 50000.0)


@register("pie_shares", sql="""
WITH c AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS count FROM orders GROUP BY 1
           ORDER BY count DESC, month ASC NULLS LAST LIMIT 30)
SELECT month, count, round(count * 100.0 / sum(count) OVER (), 1) AS pct FROM c
""")
def pie_shares(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(F.month("o_orderdate").alias("month"))
    return cd.pie_shares(o, "month", 30)


@register("box_stats", sql="""
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT o.o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(CASE WHEN o_totalprice BETWEEN lo_fence AND hi_fence THEN o_totalprice END) AS whisker_lo,
       max(CASE WHEN o_totalprice BETWEEN lo_fence AND hi_fence THEN o_totalprice END) AS whisker_hi,
       CAST(count_if(NOT (o_totalprice BETWEEN lo_fence AND hi_fence)) AS BIGINT) AS n_outliers, count(*) AS n
FROM orders o JOIN f USING (o_orderpriority) WHERE o_totalprice IS NOT NULL
GROUP BY o.o_orderpriority, q1, median, q3
""")
def box_stats(spark, sf_dir):
    return cd.box_stats(Tables(spark, sf_dir).orders, "o_orderpriority", "o_totalprice")


@register("kde", sql="""
WITH s AS (SELECT count(c_acctbal) AS n, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi
           FROM customer),
p AS (SELECT n, sd * pow(n, -1.0 / 5.0) AS bw, lo, hi FROM s),
g AS (SELECT CAST(range AS INTEGER) AS grid_idx, (lo - 3.0 * bw) + range * (((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199) AS x,
             bw, n FROM range(200), p),
d AS (SELECT c_acctbal AS v, count(*) AS m FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1)
SELECT grid_idx, round(x, 6) AS x,
       round(sum(m * exp(-0.5 * pow((x - v) / bw, 2))) * (1.0 / (n * bw * sqrt(2 * pi()))), 12) AS density
FROM g, d GROUP BY grid_idx, x, bw, n
""")
def kde(spark, sf_dir):
    return cd.kde(Tables(spark, sf_dir).customer, "c_acctbal", 200, 3.0)


def _bin_sql(c: str) -> str:
    return (f"CAST(least(floor(({c} - (SELECT min({c}) FROM lineitem)) / "
            f"(((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) / 10)), 9) AS INTEGER)")


NUMERIC_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINEITEM_NUMERIC]

_PAIR_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x_col, '{b}' AS y_col, l_returnflag, {_bin_sql(a)} AS x_bin, {_bin_sql(b)} AS y_bin, "
    f"count(*) AS count FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"
    for i, a in enumerate(NUMERIC_LI) for b in NUMERIC_LI[i + 1:]
)


@register("pair_bins", sql=_PAIR_SQL)
def pair_bins(spark, sf_dir):
    return cd.pair_bins(Tables(spark, sf_dir).lineitem, NUMERIC_LI, "l_returnflag", 10)


_CORR_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + ("1.0::DOUBLE AS corr" if a == b else f"round(corr({a}, {b}), 6) AS corr FROM lineitem")
    for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC
)


@register("corr_matrix", sql=_CORR_SQL)
def corr_matrix(spark, sf_dir):
    return cd.corr_matrix(Tables(spark, sf_dir).lineitem, LINEITEM_NUMERIC)


_CORR_NUM_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + ("1.0::DOUBLE AS corr" if a == b else f"round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM lineitem")
    for a in NUMERIC_LI for b in NUMERIC_LI
)


@register("corr_numeric", sql=_CORR_NUM_SQL)
def corr_numeric(spark, sf_dir):
    """Correlation over every numeric column, computed only when there are at least four."""
    li = Tables(spark, sf_dir).lineitem
    cols = pf.numeric_columns(li)
    if len(cols) < 4:
        return spark.createDataFrame([], "col_a string, col_b string, corr double")
    return cd.corr_matrix(li, cols)
