"""Routing, tools, validation and run-evaluation queries.

Natural texts in the driver tables almost never exercise the router, so the
query column is generated from lineitem x part (all rows):
  (l_orderkey + l_linenumber) mod 3 = 0 -> "calculate <qty> * <linenumber> + <size>" for even order keys,
                                           "calculate <qty> / <discount in percent> + <size>" for odd ones
                                           (a discount of zero makes the calculator fail)
                                    = 1 -> "extract the keywords from <p_name> <p_type>"
                                    = 2 -> "tell me about <p_name>"
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import router as rt
from tessera.functions import text as tx
from tessera.operators import routing as ro
from tessera.plans.registry import register
from tessera.sources.tables import Tables

KEYS = ["l_orderkey", "l_linenumber"]

# Rule sets checked against events.props (every payload there is {"k": <int>}).
RULE_SETS = {
    "number_k": {"type": "object", "required": ["k"], "properties": {"k": {"type": "number"}}},
    "string_k": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string"}}},
    "needs_text": {"type": "object", "required": ["k", "text"], "properties": {"text": {"type": "string"}}},
    "small_k": {"type": "object", "required": ["k"],
                "properties": {"k": {"type": "number", "enum": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]}}},
    "bool_k": {"type": "object", "properties": {"k": {"type": "boolean"}}},
}


def generated_queries(t):
    li = t.lineitem.select(*KEYS, "l_partkey", "l_quantity", "l_discount")
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size")
    kind = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(3))
    percent = F.round(F.col("l_discount") * 100).cast("bigint")
    query = (
        F.when(kind == 0, F.concat(F.lit("calculate "), F.col("l_quantity").cast("bigint").cast("string"),
                                   F.when(F.col("l_orderkey") % 2 == 0,
                                          F.concat(F.lit(" * "), F.col("l_linenumber").cast("string")))
                                   .otherwise(F.concat(F.lit(" / "), percent.cast("string"))),
                                   F.lit(" + "), F.col("p_size").cast("string")))
        .when(kind == 1, F.concat(F.lit("extract the keywords from "), F.col("p_name"), F.lit(" "), F.col("p_type")))
        .otherwise(F.concat(F.lit("tell me about "), F.col("p_name")))
    )
    return li.join(part, "l_partkey").select(*KEYS, query.alias("query"))


_GQ = """
gq AS (SELECT l_orderkey, l_linenumber,
              CASE (l_orderkey + l_linenumber) % 3
                WHEN 0 THEN 'calculate ' || CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)
                            || CASE WHEN l_orderkey % 2 = 0 THEN ' * ' || CAST(l_linenumber AS VARCHAR)
                                    ELSE ' / ' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END
                            || ' + ' || CAST(p_size AS VARCHAR)
                WHEN 1 THEN 'extract the keywords from ' || p_name || ' ' || p_type
                ELSE 'tell me about ' || p_name END AS query,
              CASE WHEN l_orderkey % 2 = 0 THEN CAST(CAST(trunc(l_quantity) AS BIGINT) * l_linenumber + p_size AS DOUBLE)
                   ELSE CAST(trunc(l_quantity) AS DOUBLE) / nullif(CAST(round(l_discount * 100) AS DOUBLE), 0) + p_size
              END AS calc_value
       FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_ROUTE_SQL = (f"CASE WHEN contains(lower({{q}}), '{rt.CALC_WORD}') OR regexp_matches(lower({{q}}), '{rt.CALC_PATTERN}') "
              f"THEN 'calculator' WHEN contains(lower({{q}}), '{rt.KEYWORD_WORD}') THEN 'keywords' ELSE 'general' END")


def _route(q: str) -> str:
    return _ROUTE_SQL.format(q=q)


@register("route_intent", sql=f"WITH {_GQ} SELECT l_orderkey, l_linenumber, query, {_route('query')} AS route FROM gq")
def route_intent(spark, sf_dir):
    return generated_queries(Tables(spark, sf_dir)).withColumn("route", rt.route("query"))


@register("route_documents", sql=f"SELECT doc_id, {_route('text')} AS route FROM documents")
def route_documents(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", rt.route("text").alias("route"))


@register("arith_expr", sql=f"""
WITH {_GQ}
SELECT l_orderkey, l_linenumber,
       CASE WHEN regexp_extract(query, '{rt.CHAIN_PATTERN}', 0) = '' THEN '0'
            ELSE regexp_extract(query, '{rt.CHAIN_PATTERN}', 0) END AS expression
FROM gq
""")
def arith_expr(spark, sf_dir):
    return generated_queries(Tables(spark, sf_dir)).select(*KEYS, rt.arith_expression("query").alias("expression"))


@register("arith_value", sql=f"""
WITH {_GQ}
SELECT l_orderkey, l_linenumber, regexp_extract(query, '{rt.CHAIN_PATTERN}', 0) AS expression,
       calc_value AS value, CASE WHEN calc_value IS NULL THEN 'division by zero' END AS error
FROM gq WHERE {_route('query')} = 'calculator'
""")
def arith_value(spark, sf_dir):
    q = generated_queries(Tables(spark, sf_dir)).where(rt.route("query") == rt.ROUTE_CALCULATOR)
    e = q.select(*KEYS, rt.arith_expression("query").alias("expression"))
    v = ro.with_arith_value(e, "expression", "calc")
    return v.select(*KEYS, "expression", F.col("calc.value").alias("value"), F.col("calc.error").alias("error"))


_PYTYPE = """CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
             WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType'
             WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' END"""
_HAS_K = "list_contains(json_keys(props), 'k')"


@register("json_validate", sql=f"""
WITH e AS (SELECT event_id, props, {_PYTYPE} AS kt FROM events),
r AS (
  SELECT event_id, 'number_k' AS rule_set,
         CASE WHEN NOT {_HAS_K} THEN 'Missing required field: ''k'''
              WHEN kt NOT IN ('int', 'float', 'bool') THEN 'Field ''k'' expected number, got ' || kt END AS error FROM e
  UNION ALL
  SELECT event_id, 'string_k',
         CASE WHEN NOT {_HAS_K} THEN 'Missing required field: ''k'''
              WHEN kt <> 'str' THEN 'Field ''k'' expected string, got ' || kt END FROM e
  UNION ALL
  SELECT event_id, 'needs_text',
         CASE WHEN NOT {_HAS_K} THEN 'Missing required field: ''k'''
              WHEN NOT list_contains(json_keys(props), 'text') THEN 'Missing required field: ''text''' END FROM e
  UNION ALL
  SELECT event_id, 'small_k',
         CASE WHEN NOT {_HAS_K} THEN 'Missing required field: ''k'''
              WHEN kt NOT IN ('int', 'float', 'bool') THEN 'Field ''k'' expected number, got ' || kt
              WHEN CAST(json_extract(props, '$.k') AS DOUBLE) NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
                   THEN 'Field ''k''=' || json_extract(props, '$.k') || ' not in enum [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]'
         END FROM e
  UNION ALL
  SELECT event_id, 'bool_k',
         CASE WHEN {_HAS_K} AND kt <> 'bool' THEN 'Field ''k'' expected boolean, got ' || kt END FROM e)
SELECT event_id, rule_set, error, error IS NULL AS valid FROM r
""")
def json_validate(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("event_id", "props")
    return ro.validate_payloads(ev, ["event_id"], "props", RULE_SETS)


def _repr_sql(q: str) -> str:
    esc = f"replace({q}, '\\', '\\\\')"
    for char, text in (("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")):
        esc = f"replace({esc}, {char}, '{text}')"
    return (f"CASE WHEN contains({q}, '''') AND NOT contains({q}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


_KW_SQL = (f"CASE WHEN len(list_distinct(regexp_extract_all(lower(query), '{tx.KEYWORD_PATTERN}'))) > 0 THEN "
           f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(query), '{tx.KEYWORD_PATTERN}'))), ', ') "
           f"ELSE '{tx.NO_KEYWORDS}' END")

_ANSWERED = f"""
{_GQ},
rq AS (SELECT *, {_route('query')} AS route FROM gq),
ans AS (SELECT l_orderkey, l_linenumber, query, route,
               CASE WHEN route = 'calculator' THEN regexp_extract(query, '{rt.CHAIN_PATTERN}', 0) END AS expression,
               CASE WHEN route = 'calculator' THEN calc_value END AS result_value,
               CASE WHEN route = 'keywords' THEN {_KW_SQL}
                    WHEN route = 'general' THEN '{rt.GENERAL_TEMPLATE.replace("'", "''")}' || {_repr_sql('query')}
               END AS result_text,
               CASE WHEN route = 'calculator' AND calc_value IS NULL THEN 'division by zero' END AS tool_error
        FROM rq),
fin AS (SELECT *, CASE WHEN tool_error IS NOT NULL THEN 'Calculator tool failed after 3 attempts' END AS error,
               CASE WHEN tool_error IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status,
               CASE WHEN tool_error IS NULL THEN 1 ELSE 3 END AS tool_calls,
               CASE WHEN tool_error IS NULL THEN 0 ELSE 3 END AS retries FROM ans)"""


def _answered(t):
    return ro.route_and_answer(generated_queries(t), KEYS, "query")


@register("route_and_answer", sql=f"WITH {_ANSWERED} SELECT * FROM fin")
def route_and_answer(spark, sf_dir):
    return _answered(Tables(spark, sf_dir))


@register("trajectory", sql=f"""
WITH {_ANSWERED},
ids AS (SELECT *, substring(sha256(query || ':' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)),
                           1, 8) AS run_id FROM fin)
SELECT l_orderkey, l_linenumber, run_id, 1 AS step, 'query_analysis' AS node,
       'Routed query to ''' || route || '''' AS detail, route, CAST(NULL AS INTEGER) AS attempt,
       CAST(NULL AS VARCHAR) AS error FROM ids
UNION ALL
SELECT l_orderkey, l_linenumber, run_id, 2,
       CASE route WHEN 'calculator' THEN 'calculator_tool' WHEN 'keywords' THEN 'keyword_extraction_tool'
                  ELSE 'general_response' END,
       CASE route WHEN 'calculator' THEN 'Computed ' || expression || ' = ' || CAST(result_value AS VARCHAR) || ' (attempt 1)'
                  WHEN 'keywords' THEN 'Extracted keywords: ' || result_text ELSE result_text END,
       NULL, CASE route WHEN 'calculator' THEN 1 END, NULL FROM ids WHERE tool_error IS NULL
UNION ALL
SELECT l_orderkey, l_linenumber, run_id, 1 + a.i, 'calculator_tool',
       'Attempt ' || a.i || ' failed: ' || tool_error, NULL, a.i, tool_error
FROM ids, (VALUES (1), (2), (3)) a(i) WHERE tool_error IS NOT NULL
UNION ALL
SELECT l_orderkey, l_linenumber, run_id, 5, 'calculator_tool', error, NULL, NULL, NULL FROM ids WHERE tool_error IS NOT NULL
UNION ALL
SELECT l_orderkey, l_linenumber, run_id, CASE WHEN tool_error IS NULL THEN 3 ELSE 6 END, 'finalize',
       'Pipeline finished with status: ' || status, NULL, NULL, NULL FROM ids
""")
def trajectory(spark, sf_dir):
    return ro.trajectory(_answered(Tables(spark, sf_dir)), KEYS, "query")


_ATTEMPTS_SQL = """
a AS (SELECT user_id, event_type = 'error' AS failed,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
p AS (SELECT user_id, min(CASE WHEN NOT failed THEN attempt END) AS first_success, count(*) AS n_logged
      FROM a WHERE attempt <= 3 GROUP BY user_id),
s AS (SELECT user_id, CAST(coalesce(first_success, n_logged) AS INTEGER) AS tool_calls,
             CAST(coalesce(first_success, n_logged) - CASE WHEN first_success IS NOT NULL THEN 1 ELSE 0 END AS INTEGER)
                 AS retries,
             CAST(first_success AS INTEGER) AS first_success,
             CASE WHEN first_success IS NULL THEN 'Calculator tool failed after ' || CAST(n_logged AS VARCHAR) || ' attempts'
             END AS error,
             CASE WHEN first_success IS NOT NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM p)"""


def _attempts(t):
    return ro.attempt_summary(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@register("attempt_summary", sql=f"WITH {_ATTEMPTS_SQL} SELECT * FROM s")
def attempt_summary(spark, sf_dir):
    return _attempts(Tables(spark, sf_dir))


@register("eval_summary", sql=f"""
WITH {_ATTEMPTS_SQL}
SELECT count(*) AS total_tasks, CAST(count_if(status = 'SUCCESS') AS BIGINT) AS completed_tasks,
       CAST(coalesce(sum(tool_calls), 0) AS BIGINT) AS total_tool_calls, CAST(coalesce(sum(retries), 0) AS BIGINT) AS total_retries,
       round(coalesce(count_if(status = 'SUCCESS') / nullif(count(*), 0), 0), 6) AS completion_rate,
       round(coalesce(sum(tool_calls) / nullif(count(*), 0), 0), 6) AS avg_tool_calls
FROM s
""")
def eval_summary(spark, sf_dir):
    return ro.eval_summary(_attempts(Tables(spark, sf_dir)))
