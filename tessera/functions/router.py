"""Column expressions for rule-based query routing and the batch tools.

Everything is a JVM-side expression; no branch can raise under ANSI mode
(``try_`` functions, explicit error columns instead of exceptions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
ROUTE_CALCULATOR = "calculator"
ROUTE_KEYWORDS = "keywords"
ROUTE_GENERAL = "general"
CALC_WORD = "calculate"
KEYWORD_WORD = "keyword"
# digit ... operator ... digit anywhere in the lower-cased query
CALC_PATTERN = "[0-9].*[+\\-*/].*[0-9]"
# first arithmetic chain: signed number (operator signed number)+
CHAIN_PATTERN = "[-+]?\\d*\\.?\\d+(?:\\s*[+\\-*/]\\s*[-+]?\\d*\\.?\\d+)+"
# characters the calculator accepts
SAFE_EXPR_PATTERN = "^[0-9+\\-*/().\\s]+$"
GENERAL_TEMPLATE = "I don't have a specialized tool for this, but here's my best general answer to: "
MAX_ATTEMPTS = 3
STATUS_SUCCESS, STATUS_FAILED = "SUCCESS", "FAILED"
# nodes and texts of the step log
NODE_ROUTE, NODE_FINAL = "query_analysis", "finalize"
NODE_TOOL = {ROUTE_CALCULATOR: "calculator_tool", ROUTE_KEYWORDS: "keyword_extraction_tool",
             ROUTE_GENERAL: "general_response"}
TEXT_ROUTED = ("Routed query to '", "'")
TEXT_COMPUTED = ("Computed ", " = ", " (attempt ", ")")
TEXT_ATTEMPT_FAILED = ("Attempt ", " failed: ")
TEXT_GAVE_UP = ("Calculator tool failed after ", " attempts")
TEXT_KEYWORDS = "Extracted keywords: "
TEXT_KEYWORDS_FAILED = "Failed: "
TEXT_FINISHED = "Pipeline finished with status: "
# -----------------------------------------------------------------------------

# a binary operator is an operator sign right after a digit (numbers never end in '.')
_BINARY_OP = "(?<=[0-9])[-+*/]"
# an integer literal with a leading zero ("01", "007") is a syntax error in Python
_LEADING_ZERO = "^[-+]?0[0-9]*[1-9][0-9]*$"


def route(query: Column | str) -> Column:
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    return (
        F.when(F.contains(q, F.lit(CALC_WORD)) | q.rlike(CALC_PATTERN), F.lit(ROUTE_CALCULATOR))
        .when(F.contains(q, F.lit(KEYWORD_WORD)), F.lit(ROUTE_KEYWORDS))
        .otherwise(F.lit(ROUTE_GENERAL))
    )


def arith_expression(query: Column | str) -> Column:
    """First arithmetic chain in the query, or '0'."""
    q = F.col(query) if isinstance(query, str) else query
    found = F.regexp_extract(q, CHAIN_PATTERN, 0)
    return F.when(found == "", F.lit("0")).otherwise(found)


def arith_parts(e: Column) -> dict[str, Column]:
    """Numbers (signed literals) and binary operators of a whitespace-free chain."""
    nums = F.split(e, _BINARY_OP)
    return {"nums": nums, "ops": F.regexp_extract_all(e, F.lit(_BINARY_OP), 0),
            "vals": F.transform(nums, lambda s: s.try_cast("double"))}


def arith_steps(ops: Column, vals: Column) -> Column:
    return F.arrays_zip(ops.alias("op"), F.slice(vals, 2, F.size(vals)).alias("v"))


def arith_fold(steps: Column, first: Column) -> Column:
    """Left fold keeping (sum of finished terms, current term): * and / bind tighter."""
    init = F.struct(F.lit(0.0).alias("acc"), first.alias("term"))

    def step(st, x):
        additive = (x["op"] == "+") | (x["op"] == "-")
        signed = F.when(x["op"] == "-", -x["v"]).otherwise(x["v"])
        term = (F.when(additive, signed)
                .when(x["op"] == "*", st["term"] * x["v"])
                .otherwise(F.try_divide(st["term"], x["v"])))
        acc = F.when(additive, st["acc"] + st["term"]).otherwise(st["acc"])
        return F.struct(acc.alias("acc"), term.alias("term"))

    return F.aggregate(steps, init, step)


def arith_error(e: Column, nums: Column, steps: Column, value: Column) -> Column:
    """Why no value: unsafe characters, a literal Python rejects, division by zero."""
    bad_literal = F.exists(nums, lambda s: s.rlike(_LEADING_ZERO))
    unsafe = ~e.rlike(SAFE_EXPR_PATTERN) & (e != "")
    div_zero = F.exists(steps, lambda x: (x["op"] == "/") & (x["v"] == 0))
    return (F.when(unsafe, F.lit("Unsafe or invalid expression"))
            .when(bad_literal, F.lit("leading zeros in decimal integer literals are not permitted"))
            .when(div_zero, F.lit("division by zero"))
            .when(value.isNull(), F.lit("invalid expression")))


def general_answer(query: Column | str) -> Column:
    from tessera.functions.text import py_repr
    return F.concat(F.lit(GENERAL_TEMPLATE), py_repr(query))
