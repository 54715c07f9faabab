"""``base where their.x OP literal ...``: one scan and one aggregation, however many conditions there are.

Every condition is an aggregate: does the entity have an attribute for which it holds?
An absent attribute satisfies nothing, not even ``!=``; an order of types
that have none fails the query if a row of that attribute exists.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.functions import paths as P
from waypost.functions import values as V
from waypost.operators import entity


@dataclass(frozen=True)
class Condition:
    attribute: tuple[str, ...]
    op: str
    value: Any


#: A tree of conditions: one, or ("and" | "or", [trees]).
Conditions = Condition | tuple[str, list]


def leaves(tree: Conditions) -> list[Condition]:
    return [tree] if isinstance(tree, Condition) else [c for t in tree[1] for c in leaves(t)]


def matching_entities(ep: DataFrame, base: tuple[str, ...], tree: Conditions, compat: bool = False) -> DataFrame:
    """(entity, id) of the entities below ``base`` for which the conditions hold."""
    found = list(dict.fromkeys(leaves(tree)))
    depths = sorted({len(base) + 1 + len(c.attribute) for c in found})
    if compat and len(base) != 1:
        # the second segment was taken for the id whatever the base, so deeper bases find nothing
        return entity.with_entity(ep, base).select("entity", "id").limit(0)
    plain = sorted({P.text_of(c.attribute) for c in found if not P.has_wildcards(c.attribute)})
    rows = entity.with_entity(ep, base).where(F.col("depth").isin(depths) if all(P.MANY not in c.attribute for c in found) else F.lit(True))
    if len(plain) == len({c.attribute for c in found}):
        rows = rows.where(F.col("rel").isin(plain))
    flags = []
    for i, c in enumerate(found):
        here = F.col("rel") == P.text_of(c.attribute) if not P.has_wildcards(c.attribute) else F.concat(F.lit("."), F.col("rel")).rlike(P.regex(c.attribute))
        flags.append(F.bool_or(F.when(here, V.comparison(c.op, c.value)).otherwise(F.lit(False))).alias(f"__c{i}"))

    def held(t: Conditions):
        if isinstance(t, Condition):
            return F.coalesce(F.col(f"__c{found.index(t)}"), F.lit(False))
        parts = [held(x) for x in t[1]]
        return reduce((lambda a, b: a | b) if t[0] == "or" and not compat else (lambda a, b: a & b), parts)

    return rows.groupBy("entity", "id").agg(*flags).where(held(tree)).select("entity", "id")


def filtered(ep: DataFrame, base: tuple[str, ...], tree: Conditions, compat: bool = False) -> DataFrame:
    """All endpoints of the matching entities, with entity, id and rel."""
    return entity.with_entity(ep, base).join(matching_entities(ep, base, tree, compat).select("entity"), "entity", "left_semi")
