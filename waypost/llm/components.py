"""Connected components by alternating large-star and small-star rounds.

Every round is a few shuffles of the edges; the smallest node of a component
becomes its root.  Rounds grow with the logarithm of a component's size.  Edges
of a hub are joined with one row for the hub from a written table, so Spark may split
the side of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns of nodes, each link in any direction.  Returns node, root for every node that isn't its own root."""
    a, b = edges.columns
    e = shared.written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    was = None
    while True:
        is_now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % (1 << 31))).first())
        if is_now[0] == 0 or is_now == was:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        was = is_now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = shared.written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").union(low)
        e = shared.written(small.distinct(), "edges")
