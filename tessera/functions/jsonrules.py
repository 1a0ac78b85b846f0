"""Keyed JSON validation as column expressions (VARIANT based).

A rule set is the small schema dict the tools declare::

    {"type": "object", "required": [...], "properties": {name: {"type": t, "enum": [...]}}}

Semantics kept from the tool validator: a non-object schema validates
nothing; required keys are checked in order; then the payload's own keys in
payload order, type first, then enum; the first error wins. Unknown keys and
unknown type names pass; booleans pass as numbers (bool is an int in Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# JSON type names the validator knows -> accepted Python type names.
TYPE_MAP = {"string": ("str",), "number": ("int", "float", "bool"), "boolean": ("bool",)}
# Messages.
NOT_AN_OBJECT = "Expected object, got "
MISSING = "Missing required field: '{}'"
WRONG_TYPE = "Field '{}' expected {}, got "
NOT_IN_ENUM = ("Field '{}'=", " not in enum {}")
NO_VALUE = "NoneType"
# -----------------------------------------------------------------------------


def python_type_name(variant_schema: Column) -> Column:
    """Python type name of a parsed JSON value, from ``schema_of_variant``."""
    s = variant_schema
    return (
        F.when(s.isNull(), F.lit("NoneType"))
        .when(s == "BIGINT", F.lit("int"))
        .when(s.startswith("DECIMAL(") & s.endswith(",0)"), F.lit("int"))
        .when(s.startswith("DECIMAL(") | (s == "DOUBLE") | (s == "FLOAT"), F.lit("float"))
        .when(s == "STRING", F.lit("str"))
        .when(s == "BOOLEAN", F.lit("bool"))
        .when(s == "VOID", F.lit("NoneType"))
        .when(s.startswith("OBJECT"), F.lit("dict"))
        .when(s.startswith("ARRAY"), F.lit("list"))
        .otherwise(F.lit("object"))
    )


def missing_value_error(value: Column, field: str, expected: str) -> Column:
    """The validator's message for a typed column that holds no value; null where it does."""
    return F.when(value.isNull(), F.lit(WRONG_TYPE.format(field, expected) + NO_VALUE))


def py_float(x: Column) -> Column:
    """Python's text of a double: plain digits from 1e-4 to 1e16, else an exponent of two digits at least."""
    java = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,21)").cast("string"), "0+$", ""), "\\.$", ".0")
    size = F.abs(x)
    power = F.substring_index(java, "E", -1).try_cast("int")
    digits = F.abs(power).cast("string")
    exponent = F.concat(F.regexp_replace(F.substring_index(java, "E", 1), "\\.0$", ""), F.lit("e"),
                        F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    return (F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), plain)
            .when(F.contains(java, F.lit("E")), exponent).otherwise(java))


def _value_repr(v: Column, path: str, pytype: Column) -> Column:
    from tessera.functions.text import py_repr
    as_str = F.try_variant_get(v, path, "string")
    return (F.when(pytype == "str", py_repr(as_str))
            .when(pytype == "bool", F.when(as_str == "true", F.lit("True")).otherwise(F.lit("False")))
            .when(pytype == "NoneType", F.lit("None"))
            .when(pytype == "float", py_float(F.try_variant_get(v, path, "double")))
            .otherwise(as_str))


def json_path(name: str) -> str:
    return "$." + name if name.isidentifier() else f"$['{name}']"


def field_type(v: Column, name: str, raw: Column) -> Column:
    """Python type name of a field. A whole number that is written with a point or an exponent is a float,
    which only the JSON text (``raw``) still shows."""
    found = python_type_name(F.schema_of_variant(F.try_variant_get(v, json_path(name), "variant")))
    written = F.get_json_object(raw, json_path(name))
    return F.when((found == "int") & written.rlike("[.eE]"), F.lit("float")).otherwise(found)


def validation_error(json_col: Column | str, schema: dict, keys: Column | None = None,
                     top_type: Column | None = None, field_types: dict[str, Column] | None = None) -> Column:
    """First validation error message, NULL when valid.

    ``json_col`` is a JSON string column, or an already parsed VARIANT column
    together with ``keys`` (the payload's key list in payload order) and
    ``field_types`` (Python type names of the fields, as columns), so that
    many rule sets share one type probe per field.
    """
    if schema.get("type") != "object":
        return F.lit(None).cast("string")
    raw = F.col(json_col) if isinstance(json_col, str) else json_col
    if keys is None:
        v = F.try_parse_json(raw)
        keys = F.json_object_keys(raw)
    else:
        v = raw
    top_type = top_type if top_type is not None else python_type_name(F.schema_of_variant(v))
    candidates = [F.struct(F.lit(0).alias("r"),
                           F.when(top_type != "dict", F.concat(F.lit(NOT_AN_OBJECT), top_type))
                           .alias("msg"))]
    for i, req in enumerate(schema.get("required", [])):
        candidates.append(F.struct(F.lit(1 + i).alias("r"), F.when(
            F.coalesce(~F.array_contains(keys, F.lit(req)), F.lit(True)),
            F.lit(MISSING.format(req))).alias("msg")))
    base = 1 + len(schema.get("required", []))
    for name, spec in (schema.get("properties") or {}).items():
        if not spec:
            continue
        path = json_path(name)
        pos = F.coalesce(F.array_position(keys, F.lit(name)), F.lit(0)).cast("int")
        present = pos > 0
        ptype = (field_types or {}).get(name)
        if ptype is None:
            ptype = field_type(v, name, raw)
        expected = spec.get("type")
        if expected in TYPE_MAP:
            ok = ptype.isin(*TYPE_MAP[expected])
            candidates.append(F.struct((F.lit(base) + pos * 2).alias("r"), F.when(
                present & ~ok, F.concat(F.lit(WRONG_TYPE.format(name, expected)), ptype)).alias("msg")))
        if "enum" in spec:
            allowed = spec["enum"]
            texts = [a for a in allowed if isinstance(a, str)]
            nums = [float(a) for a in allowed if isinstance(a, (int, float))]
            as_text = F.try_variant_get(v, path, "string")
            number = F.when(ptype == "bool", (as_text == "true").cast("double")).otherwise(
                F.try_variant_get(v, path, "double"))
            member = F.lit(None in allowed) & (ptype == NO_VALUE)
            if texts:
                member = member | ((ptype == "str") & as_text.isin(*texts))
            if nums:
                member = member | (ptype.isin("int", "float", "bool") & number.isin(*nums))
            candidates.append(F.struct((F.lit(base + 1) + pos * 2).alias("r"), F.when(
                present & ~F.coalesce(member, F.lit(False)),
                F.concat(F.lit(NOT_IN_ENUM[0].format(name)), _value_repr(v, path, ptype),
                         F.lit(NOT_IN_ENUM[1].format(repr(allowed))))).alias("msg")))
    found = F.array_sort(F.filter(F.array(*candidates), lambda c: c["msg"].isNotNull()))
    return F.try_element_at(found, F.lit(1))["msg"]
