"""A value index: the endpoints of registered patterns, looked up by value.

Parquet's statistics do the work of an index once the rows are sorted by
value, so ``materialize`` writes them that way; without it the same lookups are plain filters.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.functions import paths as P
from waypost.functions import values as V
from waypost.operators import scan


class ValueIndex:
    def __init__(self, ep: DataFrame):
        self.source = ep
        self.patterns: dict[str, tuple[str, ...]] = {}
        self.stored: DataFrame | None = None

    def register(self, pattern: str) -> None:
        segments = P.parse(pattern)
        self.patterns[P.text_of(segments)] = segments
        self.stored = None

    def unregister(self, pattern: str) -> None:
        self.patterns.pop(P.canonical(pattern), None)
        self.stored = None

    def covers(self, path: str) -> bool:
        """Whether an endpoint at a path is indexed."""
        return any(P.matches(P.parse(path), p) for p in self.patterns.values())

    def rows(self) -> DataFrame:
        if self.stored is not None:
            return self.stored
        if not self.patterns:
            return self.source.limit(0)
        return self.source.where(reduce(lambda a, b: a | b, [P.matching(p) for p in self.patterns.values()]))

    def materialize(self, path: str) -> None:
        """Writes the indexed rows in the order of their values."""
        order = [F.col(c) for c in ("vtype", "v_str", "v_int", "v_float", "v_bool", "v_ref")]
        self.rows().repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        self.stored = self.source.sparkSession.read.schema(V.ENDPOINT_SCHEMA).parquet(path)

    def find_by_value(self, value: Any) -> DataFrame:
        return scan.find_by_value(self.rows(), value)

    def find_by_condition(self, op: str, value: Any) -> DataFrame:
        return scan.find_by_condition(self.rows(), op, value)

    def clear(self) -> None:
        self.patterns, self.stored = {}, None
