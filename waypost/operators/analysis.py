"""Analyses over endpoints: constraints, vectors, relations, and statistics of entities."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.functions import paths as P
from waypost.functions import values as V
from waypost.operators import entity, scan

_NUMBER = "coalesce(v_float, cast(v_int AS double))"


def type_violations(ep: DataFrame, pattern: str, *tags: str) -> DataFrame:
    """Endpoints of a pattern with another type than those named."""
    return scan.query(ep, pattern).where(~F.col("vtype").isin(*tags)).select("path", "vtype")


def duplicates(ep: DataFrame, pattern: str) -> DataFrame:
    """Values that more than one endpoint of a pattern has: the value columns and n."""
    columns = ["vtype", "v_bool", "v_int", "v_float", "v_str", "v_bin", "v_ref"]
    return scan.query(ep, pattern).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def dangling(ep: DataFrame, pattern: str) -> DataFrame:
    """References of a pattern to which no endpoint, nor anything below it, exists: path, v_ref."""
    refs = scan.query(ep, pattern).where(F.col("vtype") == "reference").select("path", "v_ref")
    heads = scan.heads(ep, refs).select(F.col("__at").alias("v_ref")).distinct()
    return refs.join(heads, "v_ref", "left_anti").select("path", "v_ref")


def vector_search(ep: DataFrame, base: str, attribute: str, vector: list[float], limit: int | None, least: float = -1.0) -> DataFrame:
    """(id, similarity): the entities below ``base`` whose array attribute is nearest to a vector by cosine.

    Components are endpoints, so the products are summed by one aggregation,
    and with a limit only so many of the best rows leave the tasks.
    """
    placed = entity.with_entity(ep, P.parse(base)).where(F.col("rel").startswith(f"{attribute}.["))
    i = F.regexp_extract("rel", r"\[(\d+)\]$", 1).cast("int")
    x, q = F.expr(_NUMBER), F.get(F.array(*[F.lit(float(v)) for v in vector]), i)
    norm = sum(v * v for v in vector) ** 0.5
    found = placed.groupBy("id").agg((F.sum(x * q) / (F.sqrt(F.sum(x * x)) * norm)).alias("similarity"))
    best = found.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id")
    return best if limit is None else best.limit(limit)


def related(ep: DataFrame, base: str, attribute: str) -> DataFrame:
    """(id, other): references in an attribute, single or array, to entities below the same base."""
    placed = entity.with_entity(ep, P.parse(base)).where(F.col("vtype") == "reference")
    return placed.where((F.col("rel") == attribute) | F.col("rel").startswith(f"{attribute}.")).select("id", F.element_at(F.split("v_ref", r"\."), -1).alias("other")).distinct()


def related_of_related(links: DataFrame) -> DataFrame:
    """(id, other, n): who is two links away and not linked, nor the same; n: over how many."""
    second = links.select(F.col("id").alias("other_id"), F.col("other").alias("second"))
    two = links.join(second, F.col("other") == F.col("other_id")).where("id != second").groupBy("id", "second").agg(F.count("*").alias("n"))
    return two.join(links.select("id", F.col("other").alias("second")), ["id", "second"], "left_anti").select("id", F.col("second").alias("other"), "n")


def attribute_stats(ep: DataFrame, pattern: str) -> DataFrame:
    """Count, sum, mean, least and greatest of the numbers of a pattern."""
    x = F.expr(_NUMBER)
    return scan.query(ep, pattern).where(F.col("vtype").isin("integer", "float")).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def sorted_by(placed: DataFrame, attribute: str, value_column: str, limit: int | None = None, descending: bool = False) -> DataFrame:
    """(id, value) of an attribute in its order; with a limit only so many rows leave each task."""
    order = F.desc("value") if descending else F.asc("value")
    rows = placed.where(F.col("rel") == attribute).select("id", F.col(value_column).alias("value")).orderBy(order, "id")
    return rows if limit is None else rows.limit(limit)


def members(placed: DataFrame, attribute: str, values: list[Any]) -> DataFrame:
    """(id): entities whose attribute is one of some values."""
    held = F.lit(False)
    for v in values:
        held = held | V.equals(v)
    return placed.where((F.col("rel") == attribute) & held).select("id").distinct()
