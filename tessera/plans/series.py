"""Time-series queries on orders (the flagship slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import timeseries as ts
from tessera.plans.registry import register
from tessera.sources.tables import Tables

_MONTHLY_SQL = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       round(sum(o_totalprice), 2) AS total,
       make_date(CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER), 1) AS date
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2
"""


@register("monthly_totals", sql=_MONTHLY_SQL)
def monthly_totals(spark, sf_dir):
    return ts.monthly_totals(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice")


_FEATURES_SQL = f"""
WITH m AS ({_MONTHLY_SQL}),
f AS (
  SELECT *, lag(total, 1) OVER (ORDER BY date) AS lag_1,
         lag(total, 2) OVER (ORDER BY date) AS lag_2,
         lag(total, 3) OVER (ORDER BY date) AS lag_3,
         CASE WHEN count(total) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
              THEN round(avg(total) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)
         END AS rolling_3
  FROM m)
SELECT *, row_number() OVER (ORDER BY date) - 1 AS idx
FROM f WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL AND rolling_3 IS NOT NULL
"""


@register("ts_features", sql=_FEATURES_SQL)
def ts_features(spark, sf_dir):
    return ts.ts_features(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice")


@register("ts_split", sql=f"""
WITH f AS ({_FEATURES_SQL})
SELECT date, total, idx, CASE WHEN idx < floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
FROM f
""")
def ts_split(spark, sf_dir):
    feats = ts.ts_features(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice")
    return ts.ordered_split(feats.select("date", "total"), "date", 0.8)


_EVENT_WINDOW = "(PARTITION BY user_id ORDER BY ts, event_id)"


@register("event_features", sql=f"""
SELECT event_id, user_id, lag(value, 1) OVER {_EVENT_WINDOW} AS lag_1, lag(value, 2) OVER {_EVENT_WINDOW} AS lag_2,
       lag(value, 3) OVER {_EVENT_WINDOW} AS lag_3,
       CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 4) END AS rolling_3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def event_features(spark, sf_dir):
    """Lags and rolling mean of every user's events; a user with very many events is cut into several tasks."""
    events = Tables(spark, sf_dir).events.select("event_id", "user_id", "ts", "value")
    return ts.long_lag_features(events, "user_id", ["ts", "event_id"], "value").drop("ts", "value")
