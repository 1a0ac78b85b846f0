"""Batch query routing: route -> tool -> finalise, trajectories, attempt logs, run summary.

The reference runs one query at a time through a small node graph. The
graph is acyclic with depth 3, so for a table of queries it flattens into a
single narrow projection (no shuffle): every row is routed and answered by
column expressions. Retries are not simulated; they are read from an
attempt log (``attempt_summary``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import router as rt
from tessera.functions import text as tx
from tessera.functions.jsonrules import missing_value_error, validation_error


def with_arith_value(df: DataFrame, expr_col: str, out: str = "calc") -> DataFrame:
    """Add ``out`` = struct(value, error) for the arithmetic chain in ``expr_col``.

    Each intermediate is its own projected column (each referenced at least
    twice, so the optimizer keeps it materialised): the text is split once
    and the fold runs once per row.
    """
    cols = df.columns
    a = df.withColumn("__e", F.regexp_replace(F.col(expr_col), "\\s+", ""))
    parts = rt.arith_parts(F.col("__e"))
    b = a.select(*cols, "__e", parts["nums"].alias("__nums"), parts["ops"].alias("__ops"))
    c = b.withColumn("__vals", F.transform("__nums", lambda s: s.try_cast("double")))
    d = c.withColumn("__steps", rt.arith_steps(F.col("__ops"), F.col("__vals")))
    f = d.withColumn("__fold", rt.arith_fold(F.col("__steps"), F.element_at("__vals", 1)))
    g = f.withColumn("__value", F.col("__fold.acc") + F.col("__fold.term"))
    h = g.withColumn("__err", rt.arith_error(F.col("__e"), F.col("__nums"), F.col("__steps"), F.col("__value")))
    return h.select(*cols, F.struct(F.when(F.col("__err").isNull(), F.col("__value")).alias("value"),
                                    F.col("__err").alias("error")).alias(out))


def route_and_answer(queries: DataFrame, key_cols: Sequence[str], query_col: str = "query") -> DataFrame:
    """Route each query, validate and run its tool, finalise (status SUCCESS / FAILED).

    The calculator is tried ``MAX_ATTEMPTS`` times; a table's failures repeat, so a failing row uses all
    attempts: ``tool_error`` is what each attempt said, ``error`` the final message. A null query has no
    route of its own (general) and fails the tool's input check. Only calculator rows carry an expression,
    so the arithmetic runs for these alone.
    """
    q = F.col(query_col)
    route = F.coalesce(rt.route(q), F.lit(rt.ROUTE_GENERAL))
    routed0 = queries.select(*key_cols, query_col, route.alias("route")).withColumn(
        "expression", F.when(F.col("route") == rt.ROUTE_CALCULATOR, rt.arith_expression(q)))
    routed = with_arith_value(routed0, "expression", "calc")
    is_calc = F.col("route") == rt.ROUTE_CALCULATOR
    is_kw = F.col("route") == rt.ROUTE_KEYWORDS
    # input first, then the tool's own error, then the output, as the tools check them
    calc_error = F.coalesce(missing_value_error(F.col("expression"), "expression", "string"), F.col("calc.error"),
                            missing_value_error(F.col("calc.value"), "value", "number"))
    keywords = tx.keywords(q)
    text_error = F.when(~is_calc, missing_value_error(q, "text", "string"))
    tool_error = F.when(is_calc, calc_error).otherwise(text_error)
    failed = F.col("tool_error").isNotNull()
    text = F.when(is_kw, keywords).when(F.col("route") == rt.ROUTE_GENERAL, rt.general_answer(q))
    gave_up = F.lit(f"{rt.TEXT_GAVE_UP[0]}{rt.MAX_ATTEMPTS}{rt.TEXT_GAVE_UP[1]}")
    answered = routed.select(*key_cols, query_col, "route", "expression", F.col("calc.value").alias("result_value"),
                             text.alias("result_text"), tool_error.alias("tool_error"))
    retried = failed & (F.col("route") == rt.ROUTE_CALCULATOR)
    return answered.select(
        *key_cols, query_col, "route", "expression", "result_value", "result_text", "tool_error",
        F.when(retried, gave_up).otherwise(F.col("tool_error")).alias("error"),
        F.when(failed, F.lit(rt.STATUS_FAILED)).otherwise(F.lit(rt.STATUS_SUCCESS)).alias("status"),
        F.when(retried, rt.MAX_ATTEMPTS).otherwise(1).alias("tool_calls"),
        F.when(retried, rt.MAX_ATTEMPTS).otherwise(0).alias("retries"),
    )


def trajectory(answered: DataFrame, key_cols: Sequence[str], query_col: str = "query") -> DataFrame:
    """One row per logged step: (*keys, run_id, step 1.., node, detail, route, attempt, error).

    ``route`` is set on the routing step, ``attempt`` on each calculator attempt, ``error`` where an
    attempt or a tool failed; a failing calculator logs every attempt and a last line.
    """
    route, failed = F.col("route"), F.col("tool_error").isNotNull()

    def step(node, detail, route=None, attempt=None, error=None):
        null = F.lit(None).cast("string")
        return F.struct(F.lit(node).alias("node"), detail.alias("detail"),
                        (null if route is None else route).alias("route"),
                        F.lit(attempt).cast("int").alias("attempt"),
                        (null if error is None else error).alias("error"))

    first = step(rt.NODE_ROUTE, F.concat(F.lit(rt.TEXT_ROUTED[0]), route, F.lit(rt.TEXT_ROUTED[1])), route=route)
    last = step(rt.NODE_FINAL, F.concat(F.lit(rt.TEXT_FINISHED), F.col("status")))
    calculator, keywords, general = (rt.NODE_TOOL[r] for r in (rt.ROUTE_CALCULATOR, rt.ROUTE_KEYWORDS, rt.ROUTE_GENERAL))
    computed = step(calculator, F.concat(
        F.lit(rt.TEXT_COMPUTED[0]), F.col("expression"), F.lit(rt.TEXT_COMPUTED[1]), F.col("result_value").cast("string"),
        F.lit(f"{rt.TEXT_COMPUTED[2]}1{rt.TEXT_COMPUTED[3]}")), attempt=1)
    attempts = [step(calculator, F.concat(F.lit(f"{rt.TEXT_ATTEMPT_FAILED[0]}{i}{rt.TEXT_ATTEMPT_FAILED[1]}"),
                                          F.col("tool_error")), attempt=i, error=F.col("tool_error"))
                for i in range(1, rt.MAX_ATTEMPTS + 1)]
    extracted = step(keywords, F.concat(F.lit(rt.TEXT_KEYWORDS), F.col("result_text")))
    not_extracted = step(keywords, F.concat(F.lit(rt.TEXT_KEYWORDS_FAILED), F.col("tool_error")), error=F.col("tool_error"))
    is_calc, is_kw = route == rt.ROUTE_CALCULATOR, route == rt.ROUTE_KEYWORDS
    steps = (F.when(is_calc & failed, F.array(first, *attempts, step(calculator, F.col("error")), last))
             .when(is_calc, F.array(first, computed, last))
             .when(is_kw & failed, F.array(first, not_extracted, last))
             .when(is_kw, F.array(first, extracted, last))
             .otherwise(F.array(first, step(general, F.coalesce("result_text", "error")), last)))
    run_id = F.substring(F.sha2(F.concat_ws(":", F.col(query_col), *[F.col(k).cast("string") for k in key_cols]),
                                256), 1, 8)
    return answered.select(*key_cols, run_id.alias("run_id"), F.posexplode(steps).alias("pos", "s")).select(
        *key_cols, "run_id", (F.col("pos") + 1).alias("step"), "s.*")


def validate_payloads(df: DataFrame, key_cols: Sequence[str], json_col: str,
                      rule_sets: dict[str, dict]) -> DataFrame:
    """Every payload against every rule set in one scan: (*keys, rule_set, valid, error)."""
    # parse once per row, probe each field's type once; every rule set reads these columns
    from tessera.functions.jsonrules import field_type, python_type_name

    fields = sorted({f for sch in rule_sets.values() for f in (sch.get("properties") or {})})
    parsed = df.select(*key_cols, F.col(json_col).alias("__raw"), F.try_parse_json(json_col).alias("__v"),
                       F.json_object_keys(json_col).alias("__keys"))
    typed = parsed.select(*key_cols, "__v", "__keys",
                          python_type_name(F.schema_of_variant("__v")).alias("__top"),
                          *[field_type(F.col("__v"), f, F.col("__raw")).alias(f"__t{i}") for i, f in enumerate(fields)])
    ftypes = {f: F.col(f"__t{i}") for i, f in enumerate(fields)}
    checks = F.array(*[F.struct(F.lit(name).alias("rule_set"),
                                validation_error(F.col("__v"), schema, F.col("__keys"), F.col("__top"),
                                                 ftypes).alias("error"))
                       for name, schema in rule_sets.items()])
    parsed = typed
    return parsed.select(*key_cols, F.inline(checks)).withColumn("valid", F.col("error").isNull())


def attempt_summary(log: DataFrame, task_col: str, order_cols: Sequence[str], failed,
                    max_attempts: int = rt.MAX_ATTEMPTS) -> DataFrame:
    """Per task, from an attempt log: tool calls, retries, first successful attempt, status.

    Only the first ``max_attempts`` attempts count; the task succeeds at its
    first non-failed attempt. ``row_number() <= max_attempts`` lets Spark
    keep only that many rows per task before the shuffle (WindowGroupLimit),
    so a task with a huge log costs no more than any other.
    """
    w = Window.partitionBy(task_col).orderBy(*order_cols)
    first = (log.select(task_col, *order_cols, failed.alias("failed"))
             .withColumn("attempt", F.row_number().over(w))
             .where(F.col("attempt") <= max_attempts))
    per = first.groupBy(task_col).agg(
        F.min(F.when(~F.col("failed"), F.col("attempt"))).alias("first_success"),
        F.count(F.lit(1)).alias("n_logged"),
    )
    calls = F.coalesce(F.col("first_success"), F.col("n_logged"))
    ok = F.col("first_success").isNotNull()
    return per.select(
        task_col,
        calls.cast("int").alias("tool_calls"),
        (calls - F.when(ok, 1).otherwise(0)).cast("int").alias("retries"),
        F.col("first_success").cast("int").alias("first_success"),
        F.when(ok, F.lit(None)).otherwise(
            F.concat(F.lit(rt.TEXT_GAVE_UP[0]), calls.cast("string"), F.lit(rt.TEXT_GAVE_UP[1]))).alias("error"),
        F.when(ok, F.lit(rt.STATUS_SUCCESS)).otherwise(F.lit(rt.STATUS_FAILED)).alias("status"),
    )


def eval_summary(tasks: DataFrame, digits: int = 6) -> DataFrame:
    """Totals over per-task rows (status, tool_calls, retries) plus the two ratios (0 when empty)."""
    one = tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(F.col("status") == rt.STATUS_SUCCESS).alias("completed_tasks"),
        F.coalesce(F.sum("tool_calls"), F.lit(0)).cast("long").alias("total_tool_calls"),
        F.coalesce(F.sum("retries"), F.lit(0)).cast("long").alias("total_retries"),
    )
    return one.select(
        "*",
        F.round(F.coalesce(F.try_divide(F.col("completed_tasks"), F.col("total_tasks")), F.lit(0.0)),
                digits).alias("completion_rate"),
        F.round(F.coalesce(F.try_divide(F.col("total_tool_calls"), F.col("total_tasks")), F.lit(0.0)),
                digits).alias("avg_tool_calls"),
    )
