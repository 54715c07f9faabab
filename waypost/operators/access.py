"""Access rules: which endpoints a reader may see, as predicates that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.functions import paths as P


def visible(ep: DataFrame, rules: list[tuple[str, bool]], otherwise: bool = False) -> DataFrame:
    """Endpoints that are allowed; ``rules``: (pattern, allowed), the last that matches decides."""
    held = F.lit(otherwise)
    for pattern, allowed in rules:
        held = F.when(P.matching(P.parse(pattern)), F.lit(allowed)).otherwise(held)
    if not otherwise and any(a for _, a in rules):
        near = F.lit(False)
        for pattern, allowed in rules:
            if allowed:
                near = near | P.matching(P.parse(pattern))
        return ep.where(near & held)  # the plain disjunction can be pushed down
    return ep.where(held)
