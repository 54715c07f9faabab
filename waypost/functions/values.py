"""Typed values of endpoints: a tag and one column for each type.

A stored null is a value (tag ``null``), different from an absent endpoint.
Equality takes the type into account, order compares numbers with numbers and strings
with strings, and NaN is equal to nothing.
"""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypost.errors import InvalidOperation

#: Type tags, as they travel with the data.
TAGS = ("null", "boolean", "integer", "float", "string", "binary", "reference")
VALUE_FIELDS = [
    T.StructField("vtype", T.StringType(), False),
    T.StructField("v_bool", T.BooleanType()),
    T.StructField("v_int", T.LongType()),
    T.StructField("v_float", T.DoubleType()),
    T.StructField("v_str", T.StringType()),
    T.StructField("v_bin", T.BinaryType()),
    T.StructField("v_mime", T.StringType()),
    T.StructField("v_ref", T.StringType()),
]
VALUE_COLUMNS = [f.name for f in VALUE_FIELDS]
ENDPOINT_SCHEMA = T.StructType([T.StructField("root", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("segments", T.ArrayType(T.StringType())), *VALUE_FIELDS])
LOG_SCHEMA = T.StructType([*ENDPOINT_SCHEMA.fields, T.StructField("seq", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("ts", T.TimestampType())])
BATCHED_LOG_SCHEMA = T.StructType([*LOG_SCHEMA.fields, T.StructField("batch", T.LongType())])
_HOLDS = {"boolean": "v_bool", "integer": "v_int", "float": "v_float", "string": "v_str", "binary": "v_bin", "reference": "v_ref"}


@dataclass(frozen=True)
class Reference:
    path: str


@dataclass(frozen=True)
class Binary:
    data: bytes
    mime: str | None = None


def tag_of(value: Any) -> str:
    """The type tag of a Python value."""
    for kind, tag in ((type(None), "null"), (bool, "boolean"), (int, "integer"), (float, "float"), (str, "string"), ((bytes, bytearray, Binary), "binary"), (Reference, "reference")):
        if isinstance(value, kind):
            if tag == "integer" and not -(1 << 63) <= value < 1 << 63:
                raise InvalidOperation(f"{value} doesn't fit in 64 bits")
            return tag
    raise InvalidOperation(f"No value type for {type(value).__name__}")


def to_row(value: Any) -> dict[str, Any]:
    """The value columns of a Python value."""
    out: dict[str, Any] = dict.fromkeys(VALUE_COLUMNS)
    out["vtype"] = tag = tag_of(value)
    if isinstance(value, Binary):
        out["v_bin"], out["v_mime"] = bytes(value.data), value.mime
    elif isinstance(value, Reference):
        out["v_ref"] = value.path
    elif tag != "null":
        out[_HOLDS[tag]] = bytes(value) if tag == "binary" else value
    return out


def from_row(row: Any) -> Any:
    """The Python value of a row's value columns."""
    tag = row["vtype"]
    if tag == "null":
        return None
    if tag == "binary":
        return Binary(bytes(row["v_bin"]), row["v_mime"])
    return Reference(row["v_ref"]) if tag == "reference" else row[_HOLDS[tag]]


def json_to_value(told: Any) -> Any:
    """A decoded JSON value as a stored value: objects of type binary and reference are read, other compounds are kept as their JSON text."""
    if isinstance(told, int) and not isinstance(told, bool):
        return told if -(1 << 63) <= told < 1 << 63 else float(told)
    if isinstance(told, dict):
        if told.get("type") == "binary" and isinstance(told.get("data"), str):
            try:
                return Binary(base64.b64decode(told["data"], validate=True), told.get("mime"))
            except ValueError as e:
                raise InvalidOperation(f"Not base64: {e}") from None
        if told.get("type") == "reference" and isinstance(told.get("path"), str):
            return Reference(told["path"])
    return json.dumps(told, separators=(",", ":"), ensure_ascii=False) if isinstance(told, (dict, list)) else told


def value_to_json(value: Any) -> Any:
    """The other way; NaN and infinities become strings."""
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "inf" if value > 0 else "-inf"
    if isinstance(value, Binary):
        return {"type": "binary", "data": base64.b64encode(value.data).decode()} | ({"mime": value.mime} if value.mime else {})
    return {"type": "reference", "path": value.path} if isinstance(value, Reference) else value


def json_column() -> Column:
    """The JSON text of an endpoint's value, as a column."""
    number = F.when(F.isnan("v_float"), F.lit('"NaN"')).when(F.abs("v_float") == float("inf"), F.when(F.col("v_float") > 0, F.lit('"inf"')).otherwise(F.lit('"-inf"'))).otherwise(F.col("v_float").cast("string"))
    text = lambda c: F.expr(f"substring(to_json(struct({c} AS x)), 6, length(to_json(struct({c} AS x))) - 6)")
    return (
        F.when(F.col("vtype") == "boolean", F.col("v_bool").cast("string"))
        .when(F.col("vtype") == "integer", F.col("v_int").cast("string"))
        .when(F.col("vtype") == "float", number)
        .when(F.col("vtype") == "string", text("v_str"))
        .when(F.col("vtype") == "binary", F.to_json(F.struct(F.lit("binary").alias("type"), F.base64("v_bin").alias("data"), F.col("v_mime").alias("mime"))))
        .when(F.col("vtype") == "reference", F.to_json(F.struct(F.lit("reference").alias("type"), F.col("v_ref").alias("path"))))
        .otherwise(F.lit("null"))
    )


def equals(value: Any) -> Column:
    """Typed equality with a literal: never an error, and 5 is not 5.0."""
    tag = tag_of(value)
    same = F.col("vtype") == tag
    if tag == "null":
        return same
    if tag == "float" and math.isnan(value):
        return F.lit(False)
    if isinstance(value, Binary):
        return same & (F.col("v_bin") == F.lit(value.data)) & F.col("v_mime").eqNullSafe(F.lit(value.mime))
    literal = value.path if isinstance(value, Reference) else value
    typed = F.lit(literal).cast("long") if tag == "integer" else F.lit(literal)
    return same & (F.col(_HOLDS[tag]) == typed)


def ordered(op: str, value: Any) -> Column:
    """``<``, ``<=``, ``>`` or ``>=`` against a literal; other pairs of types than numbers and strings fail the query."""
    tag = tag_of(value)
    compare = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
    wrong = F.raise_error(F.concat(F.lit(f"InvalidOperation: {tag} can't be compared by {op} with "), F.col("vtype"))).cast("boolean")
    if tag == "string":
        return F.when(F.col("vtype") == "string", compare(F.col("v_str"), F.lit(value))).otherwise(wrong)
    if tag not in ("integer", "float"):
        return wrong
    whole = compare(F.col("v_int"), F.lit(value).cast("long")) if tag == "integer" else compare(F.col("v_int").cast("double"), F.lit(value))
    real = compare(F.col("v_float"), F.lit(float(value))) & ~F.isnan("v_float")
    if tag == "float" and math.isnan(value):
        whole = real = F.lit(False)
    return F.when(F.col("vtype") == "integer", whole).when(F.col("vtype") == "float", real).otherwise(wrong)


def comparison(op: str, value: Any) -> Column:
    if op == "==":
        return equals(value)
    return ~equals(value) if op == "!=" else ordered(op, value)


def python_compare(left: Any, op: str, right: Any) -> bool:
    """The same comparison on the driver."""
    a, b = tag_of(left), tag_of(right)
    if op in ("==", "!="):
        return (a == b and left == right) == (op == "==")
    if not (a == b == "string" or {a, b} <= {"integer", "float"}):
        raise InvalidOperation(f"{b} can't be compared by {op} with {a}")
    if a == "string":
        left, right = left.encode(), right.encode()
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
