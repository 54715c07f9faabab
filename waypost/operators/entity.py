"""Entities: the endpoints below one path, put together again.

The common form is a map from relative path to value, built by one aggregation.
``wide`` makes columns of known attributes, ``json`` nests to any depth; there the
endpoints of an entity are gathered first, then one Arrow batch of
entities after the other is nested.  An endpoint that is also the beginning of
another's path is a conflict and fails the query.
"""

from __future__ import annotations

import json as json_text
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.errors import InvalidOperation, NotFound
from waypost.functions import paths as P
from waypost.functions import values as V
from waypost.operators import scan


def with_entity(ep: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Endpoints below ``base.<id>`` with ``entity`` (path of the entity), ``id``, and ``rel``, null at the entity's own path."""
    n = len(base) + 1
    inside = ep.where(P.under((*base, P.ONE)))
    rel = F.when(F.col("depth") > n, F.array_join(F.slice("segments", n + 1, F.col("depth")), "."))
    return inside.withColumns({"entity": F.array_join(F.slice("segments", 1, n), "."), "id": F.get("segments", F.lit(n - 1)), "rel": rel})


def conflict(rels: Column) -> Column:
    """Whether one of the relative paths begins another; in the order of path and dot such a pair is adjacent."""
    marked = F.sort_array(F.transform(rels, lambda r: F.concat(r, F.lit("."))))
    after = F.slice(marked, 2, F.size(marked))
    return F.exists(F.arrays_zip(marked.alias("a"), after.alias("b")), lambda x: F.coalesce(F.startswith(x["b"], x["a"]), F.lit(False)))


def gathered(placed: DataFrame) -> DataFrame:
    """(entity, id, pairs) with all of an entity's (rel, value columns); scalars at an entity's own path are kept, conflicts fail."""
    own = F.max(F.col("rel").isNull())
    pairs = F.collect_list(F.struct("rel", *V.VALUE_COLUMNS))
    rows = placed.groupBy("entity", "id").agg(own.alias("__own"), F.sort_array(pairs).alias("pairs"))
    clash = (F.col("__own") & (F.size("pairs") > 1)) | conflict(F.transform(F.filter("pairs", lambda p: p["rel"].isNotNull()), lambda p: p["rel"]))
    checked = F.when(clash, F.raise_error(F.concat(F.lit("InvalidOperation: conflicting shapes in "), F.col("entity")))).otherwise(F.col("pairs"))
    return rows.select("entity", "id", checked.cast(rows.schema["pairs"].dataType).alias("pairs"))


def maps(placed: DataFrame) -> DataFrame:
    """(entity, id, attributes): a map from relative path to value struct."""
    value = lambda p: F.struct(*[p[c].alias(c) for c in V.VALUE_COLUMNS])
    entry = F.transform("pairs", lambda p: F.struct(F.coalesce(p["rel"], F.lit("")).alias("key"), value(p).alias("value")))
    return gathered(placed).select("entity", "id", F.map_from_entries(entry).alias("attributes"))


def nest(pairs: list[tuple[tuple[str, ...], Any]], compat: bool = False) -> Any:
    """Nested dicts and lists from (relative segments, value).

    Gaps of an array are None.  ``compat`` keeps an array under the key ``""``
    of the object around it.
    """
    root: dict = {}
    for segments, value in pairs:
        if not segments:
            if len(pairs) > 1:
                raise InvalidOperation("Empty segments")
            return value
        at = root
        for i, s in enumerate(segments):
            if i == len(segments) - 1:
                if isinstance(at.get(s), dict):
                    raise InvalidOperation(f"A value where an object is: {'.'.join(segments)}")
                at[s] = (value,)
            else:
                at = at.setdefault(s, {})
                if not isinstance(at, dict):
                    raise InvalidOperation(f"An object where a value is: {'.'.join(segments)}")

    def built(node: Any) -> Any:
        if isinstance(node, tuple):
            return node[0]
        items = {P.as_index(k): v for k, v in node.items() if P.is_array_index(k)}
        names = {k: built(v) for k, v in node.items() if not P.is_array_index(k)}
        if not items:
            return names
        array = [built(items[i]) if i in items else None for i in range(max(items) + 1)]
        if names and not compat:
            raise InvalidOperation("An object and an array at one path")
        return names | {"": array} if compat else array

    return built(root)


def _nester(compat: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for pairs in batch.column(2).to_pylist():
                tree = nest([(P.parse(p["rel"], compat) if p["rel"] is not None else (), V.value_to_json(V.from_row(p))) for p in pairs], compat)
                texts.append(json_text.dumps(tree, separators=(",", ":"), ensure_ascii=False, sort_keys=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["entity", "id", "json"])

    return run


def json(placed: DataFrame, compat: bool = False) -> DataFrame:
    """(entity, id, json): nested JSON text, keys in order."""
    return gathered(placed).mapInArrow(_nester(compat), "entity string, id string, json string")


def flat_json(placed: DataFrame) -> DataFrame:
    """The same for entities of one level without arrays, with built-in functions only."""
    each = placed.select("entity", "id", "rel", V.json_column().alias("v"))
    line = F.concat(F.lit('"'), F.col("rel"), F.lit('":'), F.col("v"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col("rel").alias("r"), line.alias("l"))))
    return each.groupBy("entity", "id").agg(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["l"]), ","), F.lit("}")).alias("json"))


def wide(placed: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(id, name...) of known attributes; ``columns``: name to (relative path, value column)."""
    picked = [F.max(F.when(F.col("rel") == rel, F.col(v))).alias(name) for name, (rel, v) in columns.items()]
    rels = sorted({rel for rel, _ in columns.values()})
    return placed.where(F.col("rel").isin(rels)).groupBy("id").agg(*picked)


def arrays(placed: DataFrame, rel: str, value_column: str) -> DataFrame:
    """(id, items): one array attribute, dense, gaps null."""
    under = placed.where(F.col("rel").startswith(f"{rel}.[")).select("id", F.regexp_extract("rel", r"\[(\d+)\]$", 1).cast("int").alias("i"), F.col(value_column).alias("v"))
    entries = under.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"), F.max("i").alias("last"))
    return entries.select("id", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.try_element_at("m", i)).alias("items"))


#: Endpoints that may come to the driver as one entity.
MOST_ON_DRIVER = 100_000


def reconstruct(ep: DataFrame, path: str, compat: bool = False, most: int = MOST_ON_DRIVER) -> Any:
    """One entity as Python data: a scalar, dict or list; its endpoints come to the driver, and more than ``most`` are refused."""
    segments = P.parse(path)
    rows = scan.get_prefix(ep, P.text_of(segments)).select("path", "segments", *V.VALUE_COLUMNS).limit(most + 1).collect()
    if not rows:
        raise NotFound(path)
    if len(rows) > most:
        raise InvalidOperation(f"{path} has more than {most} endpoints: read it by entities() or a shape")
    return nest([(tuple(r["segments"][len(segments) :]), V.from_row(r)) for r in sorted(rows, key=lambda r: r["path"])], compat)
