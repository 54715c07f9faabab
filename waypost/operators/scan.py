"""Point lookups, prefix scans, pattern scans and lookups by value, all on an endpoints DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.errors import NotFound, PathError
from waypost.functions import paths as P
from waypost.functions import values as V


def get(ep: DataFrame, path: str) -> DataFrame:
    """The endpoint at exactly ``path``: no row or one."""
    segments = P.parse(path)
    return ep.where((F.col("root") == segments[0]) & (F.col("path") == P.text_of(segments)))


def get_value(ep: DataFrame, path: str) -> Any:
    row = get(ep, path).first()
    if row is None:
        raise NotFound(path)
    return V.from_row(row)


def exists(ep: DataFrame, path: str) -> bool:
    return not get(ep, path).isEmpty()


def get_prefix(ep: DataFrame, prefix: str) -> DataFrame:
    """All endpoints at or below ``prefix``, which may hold wildcards for single segments; all of them for an empty one."""
    return ep.where(P.under(P.parse(prefix))) if prefix else ep


def list_prefix(ep: DataFrame, prefix: str) -> DataFrame:
    return get_prefix(ep, prefix).select("path")


def query(ep: DataFrame, pattern: str, compat: bool = False) -> DataFrame:
    """Endpoints that match a pattern; an empty pattern matches nothing."""
    try:
        segments = P.parse(pattern, compat)
    except PathError:
        return ep.limit(0)
    return ep.where(P.matching(segments, compat))


def count(ep: DataFrame) -> DataFrame:
    return ep.agg(F.count("*").alias("n"))


def count_prefix(ep: DataFrame, prefix: str) -> DataFrame:
    return count(get_prefix(ep, prefix))


def find_by_value(ep: DataFrame, value: Any, pattern: str | None = None) -> DataFrame:
    """Endpoints with this value, type included; only those that match ``pattern``, where given."""
    return (query(ep, pattern) if pattern else ep).where(V.equals(value))


def find_by_condition(ep: DataFrame, op: str, value: Any, pattern: str | None = None) -> DataFrame:
    """Endpoints whose value compares so with a literal; other types than the literal's are passed over."""
    kinds = {"string": ["string"], "integer": ["integer", "float"], "float": ["integer", "float"]}.get(V.tag_of(value), [])
    rows = query(ep, pattern) if pattern else ep
    if op in ("==", "!="):
        return rows.where(V.comparison(op, value))
    return rows.where(F.col("vtype").isin(kinds) & V.comparison(op, value)) if kinds else rows.limit(0)


def type_census(ep: DataFrame) -> DataFrame:
    return ep.groupBy("root", "vtype").agg(F.count("*").alias("n"))


def heads(ep: DataFrame, refs: DataFrame) -> DataFrame:
    """``ep`` with ``__at``, each beginning of its path that a reference (v_ref) might mean: only roots that references have, and only their depths."""
    of = F.split("v_ref", r"\.")
    depths = refs.select(of[0].alias("root"), F.size(of).alias("n")).groupBy("root").agg(F.collect_set("n").alias("__depths"))  # no more than a path's depth has numbers
    reached = F.filter("__depths", lambda n: n <= F.col("depth"))
    return ep.join(depths, "root").withColumn("__at", F.explode(F.transform(reached, lambda n: F.array_join(F.slice("segments", 1, n), ".")))).drop("__depths").select(*ep.columns, "__at")


def dereference(ep: DataFrame, target: DataFrame) -> DataFrame:
    """References of ``ep`` with the endpoints of ``target`` at or below what they refer to: from_path, and the target's columns."""
    refs = ep.where(F.col("vtype") == "reference").select(F.col("path").alias("from_path"), F.col("v_ref").alias("__ref"))
    return refs.join(heads(target, refs.withColumnRenamed("__ref", "v_ref")), F.col("__ref") == F.col("__at")).drop("__ref", "__at")
