"""Tables as endpoints, and endpoints as tables again.

``shred`` turns every cell into a row in one pass without a shuffle:
the cells of a row are an array of structs that ``inline`` unfolds.  Nested structs,
maps and arrays become deeper paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypost.functions import values as V

_CELL = T.StructType([T.StructField("rel", T.StringType()), *V.VALUE_FIELDS])


def _cell(rel: Column, value: Column, kind: T.DataType) -> Column:
    """One scalar as a struct of the value columns."""
    holds = {f.name: F.lit(None).cast(f.dataType) for f in V.VALUE_FIELDS}
    if isinstance(kind, T.BooleanType):
        tag, name, stored = "boolean", "v_bool", value
    elif isinstance(kind, T.IntegralType):
        tag, name, stored = "integer", "v_int", value.cast("long")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        tag, name, stored = "float", "v_float", value.cast("double")
    elif isinstance(kind, T.BinaryType):
        tag, name, stored = "binary", "v_bin", value
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        tag, name, stored = "string", "v_str", F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        tag, name, stored = "string", "v_str", value.cast("string")
    holds["vtype"] = F.when(value.isNull(), F.lit("null")).otherwise(F.lit(tag))
    holds[name] = stored
    return F.struct(rel.alias("rel"), *[c.alias(n) for n, c in holds.items()]).cast(_CELL)


def _cells(rel: Column, value: Column, kind: T.DataType) -> Column:
    """All scalars of a value as an array of structs; a null of any type is one stored null."""
    if isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x, i: _cells(F.concat(rel, F.lit(".["), i.cast("string"), F.lit("]")), x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        inner = F.flatten(F.transform(F.map_entries(value), lambda e: _cells(F.concat(rel, F.lit("."), e["key"].cast("string")), e["value"], kind.valueType)))
    elif isinstance(kind, T.StructType):
        inner = F.concat(*[_cells(F.concat(rel, F.lit(f".{f.name}")), value[f.name], f.dataType) for f in kind.fields])
    else:
        return F.array(_cell(rel, value, kind))
    return F.when(value.isNull(), F.array(_cell(rel, F.lit(None).cast("string"), T.StringType()))).otherwise(inner)


def as_endpoints(rows: DataFrame) -> DataFrame:
    """Endpoints from rows of ``path`` and value columns."""
    segments = F.split("path", r"\.", -1)
    return rows.select(F.get(segments, F.lit(0)).alias("root"), F.size(segments).alias("depth"), "path", segments.alias("segments"), *V.VALUE_COLUMNS)


def shred(df: DataFrame, root: str, entity: Column, columns: list[str] | None = None) -> DataFrame:
    """Every cell of ``df`` as an endpoint ``root.entity.column``; ``entity``: text of the key, without dots."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.concat(*[_cells(F.lit(c), F.col(f"`{c}`"), kinds[c]) for c in columns or df.columns])
    base = F.concat(F.lit(f"{root}."), entity.cast("string"))
    rows = df.select(base.alias("__base"), cells.alias("__cells")).select("__base", F.inline("__cells"))
    return as_endpoints(rows.select(F.concat("__base", F.lit("."), "rel").alias("path"), *V.VALUE_COLUMNS))


def keyed(prefix: str, *keys: str) -> Column:
    """The usual text of an entity: ``prefix-key`` or ``prefix-key-key``."""
    return F.concat_ws("-", F.lit(prefix), *[F.col(k).cast("string") for k in keys])


def from_pairs(spark: SparkSession, pairs: dict) -> DataFrame:
    """Endpoints from a dict of path to Python value; the data is local."""
    from waypost.functions import paths as P

    rows = []
    for path, value in pairs.items():
        segments = P.checked_path(path)
        rows.append((segments[0], len(segments), P.text_of(segments), list(segments), *V.to_row(value).values()))
    return spark.createDataFrame(rows, V.ENDPOINT_SCHEMA)


def from_json_text(df: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Endpoints from rows of a path and the JSON text of its value, decoded as the clients' interface does."""
    text = F.trim(F.col(value))
    kind = F.substring(text, 1, 1)
    told = F.from_json(text, "type string, path string, data string, mime string")
    binary = (kind == "{") & (told["type"] == "binary") & told["data"].isNotNull()
    reference = (kind == "{") & (told["type"] == "reference") & told["path"].isNotNull()
    string = kind == '"'
    whole = text.rlike(r"^-?[0-9]+$") & F.expr(f"try_cast(trim(`{value}`) AS BIGINT) IS NOT NULL")
    number = F.expr(f"try_cast(trim(`{value}`) AS DOUBLE)")
    tag = (
        F.when(F.col(value).isNull() | (text == "null"), "null").when(text.isin("true", "false"), "boolean").when(string, "string").when(binary, "binary").when(reference, "reference")
        .when(kind.isin("{", "["), "string").when(whole, "integer").when(number.isNotNull(), "float")
        .otherwise(F.raise_error(F.concat(F.lit("InvalidOperation: not JSON: "), text)))
    )
    unquoted = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string")["x"]
    holds = {
        "vtype": tag, "v_bool": F.when(tag == "boolean", text == "true"), "v_int": F.when(tag == "integer", F.expr(f"try_cast(trim(`{value}`) AS BIGINT)")), "v_float": F.when(tag == "float", number),
        "v_str": F.when(string, unquoted).when(tag == "string", text), "v_bin": F.when(tag == "binary", F.unbase64(told["data"])), "v_mime": F.when(tag == "binary", told["mime"]), "v_ref": F.when(tag == "reference", told["path"]),
    }
    return as_endpoints(df.select(F.col(path).alias("path"), *[c.alias(n) for n, c in holds.items()]))
