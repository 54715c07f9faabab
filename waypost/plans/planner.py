"""Runs parsed queries against a store: statements in order, writes in an overlay, one commit at the end.

A filter, a shape and a wildcard are planned as one DataFrame each; point
reads come to the driver.  Whatever can be rejected is rejected before any job starts.
"""

from __future__ import annotations

import uuid as uuids
from datetime import UTC, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost import render
from waypost.errors import InvalidOperation, NotFound
from waypost.functions import paths as P
from waypost.functions import values as V
from waypost.operators import analysis, entity, scan, where
from waypost.plans import language as L

FUNCTIONS = ("count", "now", "uuid", "days", "endpoints", "sum", "avg", "min", "max", "history", "snapshot", "vector_search", "related_of_related")
#: Arguments that may be given by name.
NAMED = {"history": ("from", "to"), "snapshot": ("as_of", "until"), "vector_search": ("limit", "min_similarity")}
#: Columns of ``attribute_stats`` by function.
STATS = {"sum": "total", "avg": "mean", "min": "least", "max": "greatest"}


def condition_of(c: L.Compare) -> where.Condition:
    """``their.x OP literal`` in either order."""
    if isinstance(c.left, L.Their) and isinstance(c.right, L.Literal):
        return where.Condition(c.left.segments, c.op, c.right.value)
    if isinstance(c.left, L.Literal) and isinstance(c.right, L.Their):
        return where.Condition(c.right.segments, L.FLIPPED[c.op], c.left.value)
    raise InvalidOperation("A condition compares their.attribute with a literal")


def conditions_of(tree: Any) -> Any:
    if isinstance(tree, L.Compare) and tree.op == "in":
        if not isinstance(tree.left, L.Their) or not isinstance(tree.right, L.Items):
            raise InvalidOperation("in has their.attribute before and a list after it")
        found = [conditions_of(L.Compare(tree.left, "==", v)) for v in tree.right.values]
        return ("or", found) if found else where.Condition(tree.left.segments, "==", float("nan"))  # which equals nothing
    if isinstance(tree, L.Compare):
        found = condition_of(tree)
        if not found.attribute:
            raise InvalidOperation("their needs an attribute")
        if found.op not in ("==", "!=") and V.tag_of(found.value) not in ("integer", "float", "string"):
            raise InvalidOperation(f"{V.tag_of(found.value)} has no order")
        return found
    return (tree[0], [conditions_of(t) for t in tree[1]])


def known(tree: Any) -> Any:
    """Conditions with 0 for what is only known when the query runs, so the rest can be checked before."""
    if not isinstance(tree, L.Compare):
        return (tree[0], [known(t) for t in tree[1]])
    side = lambda x: L.Literal(0) if isinstance(x, (L.Var, L.Arith)) else x
    right = L.Items((L.Literal(0),)) if tree.op == "in" and isinstance(tree.right, (L.Var, L.Items)) else side(tree.right)
    return L.Compare(side(tree.left), tree.op, right)


def endpoint_conditions(tree: Any) -> Column:
    """Conditions on ``path.includes(text)`` and ``value``, as a predicate; values of other types than the literal's are passed over."""
    if not isinstance(tree, L.Compare):
        parts = [endpoint_conditions(t) for t in tree[1]]
        return reduce((lambda a, b: a | b) if tree[0] == "or" else (lambda a, b: a & b), parts)
    left, op, right = (tree.left, tree.op, tree.right) if isinstance(tree.right, L.Literal) else (tree.right, L.FLIPPED.get(tree.op), tree.left)
    if not isinstance(right, L.Literal) or left not in (L.PathOf(("path",)), L.PathOf(("value",))) or (op == "includes") != (left.segments == ("path",)):
        raise InvalidOperation("A condition on endpoints is path.includes(text) or compares value with a literal")
    if op == "includes":
        if not isinstance(right.value, str):
            raise InvalidOperation("path.includes takes a text")
        return F.contains(F.col("path"), F.lit(right.value))
    if op in ("==", "!="):
        return V.comparison(op, right.value)
    kinds = ["string"] if isinstance(right.value, str) else ["integer", "float"]
    return F.when(F.col("vtype").isin(kinds), V.comparison(op, right.value)).otherwise(F.lit(False))


def check(node: Any) -> None:
    """Rejects what no store could answer."""
    if isinstance(node, L.Arith):
        check(node.left)
        check(node.right)
    if isinstance(node, L.Their):
        raise InvalidOperation("their stands outside a where")
    if isinstance(node, L.Call):
        if node.name not in FUNCTIONS:
            raise InvalidOperation(f"Unknown function: {node.name}")
        if node.name not in ("now", "uuid") and len(node.args) != (2 if node.name == "vector_search" else 1):
            raise InvalidOperation(f"{node.name} takes {'two arguments' if node.name == 'vector_search' else 'one argument'}")
        if node.name in ("endpoints", "history", "snapshot", "related_of_related", *STATS) and not isinstance(node.args[0], L.PathOf):
            raise InvalidOperation(f"{node.name} takes a path or pattern")
        if unknown := [k for k, _ in node.named if k not in NAMED.get(node.name, ())]:
            raise InvalidOperation(f"{node.name} has no argument {unknown[0]}")
        for a in (*node.args, *(v for _, v in node.named)):
            check(a)
    if isinstance(node, L.Sorted):
        check(node.base)
    if isinstance(node, L.Items):
        for v in node.values:
            check(v)
    if isinstance(node, L.Where):
        if isinstance(node.base, L.Call) and node.base.name == "endpoints":
            check(node.base)
            endpoint_conditions(known(node.tree))
            return
        if not isinstance(node.base, L.PathOf):
            raise InvalidOperation("where needs a path before it")
        conditions_of(known(node.tree))


def shaped(ep: DataFrame, base: tuple[str, ...], fields: tuple) -> DataFrame:
    """(entity, id, json) with only the named attributes; ``base``: path of the entities, its last segment an id or ``*``."""
    flat: list[tuple[tuple[str, ...], str]] = []

    def walk(of: tuple, names: tuple[str, ...]) -> None:
        for name, what in of:
            if what and isinstance(what[0], tuple):
                walk(what, (*names, name))
            else:
                flat.append(((*names, name), P.text_of(what)))

    walk(fields, ())
    n = len(base)
    inside = ep.where(P.under(base) & (F.col("depth") > n)).withColumns({"entity": F.array_join(F.slice("segments", 1, n), "."), "id": F.get("segments", F.lit(n - 1)), "rel": F.array_join(F.slice("segments", n + 1, F.col("depth")), ".")})
    wanted = inside.where(F.col("rel").isin(sorted({rel for _, rel in flat})))
    values = {rel: F.max(F.when(F.col("rel") == rel, V.json_column())).alias(f"__{i}") for i, rel in enumerate(sorted({rel for _, rel in flat}))}
    rows = wanted.groupBy("entity", "id").agg(*values.values())
    at = {rel: F.col(f"__{i}") for i, rel in enumerate(values)}

    def text(of: tuple) -> Column:
        parts = [F.concat(F.lit(f'"{name}":'), text(what) if what and isinstance(what[0], tuple) else at[P.text_of(what)]) for name, what in of]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))  # concat_ws passes over absent attributes

    return rows.select("entity", "id", text(fields).alias("json"))


class Run:
    """One query: the state its statements see."""

    def __init__(self, store):
        self.store, self.compat = store, store.compat
        self.writes: dict[str, tuple[Any, bool]] = {}
        self.variables: dict[str, Any] = {}

    def resolved(self, segments: tuple[str, ...]) -> tuple[str, ...]:
        """Segments with variables' values in place of their names."""
        if not any(isinstance(s, L.Held) for s in segments):
            return segments
        out: list[str] = []
        for s in segments:
            value = self.variables[s] if isinstance(s, L.Held) else s
            if not isinstance(value, str) and (isinstance(value, bool) or not isinstance(value, int)):
                raise InvalidOperation(f"{s} is no segment of a path")
            out.append(str(value))
        return tuple(out)

    def filled(self, tree: Any) -> Any:
        """Conditions with the values of variables and arithmetic."""
        if not isinstance(tree, L.Compare):
            return (tree[0], [self.filled(t) for t in tree[1]])
        side = lambda x: L.Literal(self.scalar(x)) if isinstance(x, (L.Var, L.Arith)) else x
        if tree.op != "in":
            return L.Compare(side(tree.left), tree.op, side(tree.right))
        if isinstance(tree.right, L.Var):
            held = self.value(tree.right)
            if not isinstance(held, list):
                raise InvalidOperation(f"{tree.right.name} is no list")
            return L.Compare(tree.left, "in", L.Items(tuple(L.Literal(v) for v in held)))
        return L.Compare(tree.left, "in", L.Items(tuple(map(side, tree.right.values))))

    def variable(self, node: L.Var) -> Any:
        found = self.variables[node.name]
        for s in self.resolved(node.segments):
            i = P.as_index(s)
            if isinstance(found, list) and i is not None and i < len(found):
                found = found[i]
            elif isinstance(found, dict) and s in found:
                found = found[s]
            else:
                raise NotFound(P.text_of((node.name, *node.segments)))
        return found

    def arith(self, node: L.Arith) -> Any:
        a, b = self.scalar(node.left), self.scalar(node.right)
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        if isinstance(b, timedelta) and isinstance(a, str) and node.op in "+-":
            try:
                at = datetime.fromisoformat(a)
            except ValueError:
                raise InvalidOperation(f"{a} is no time") from None
            return (at + b if node.op == "+" else at - b).isoformat()
        if node.op == "+" and isinstance(a, str) and isinstance(b, str):
            return a + b
        if not number(a) or not number(b) or (node.op == "/" and b == 0):
            raise InvalidOperation(f"No {node.op} of {a!r} and {b!r}")
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[node.op]()

    def endpoints(self) -> DataFrame:
        return self.store.overlaid(self.writes)

    def get(self, path: str) -> Any:
        if path in self.writes:
            value, deleted = self.writes[path]
            if deleted:
                raise NotFound(path)
            return value
        return self.store.get(path)

    def scalar(self, node: Any) -> Any:
        """A value to store or return; entities become JSON text."""
        found = self.value(node)
        if isinstance(found, DataFrame):
            if "json" in found.columns:
                return "[" + ", ".join(r["json"] for r in found.orderBy(found.columns[0]).toLocalIterator()) + "]"
            return "[" + ", ".join(render.text_value(V.from_row(r)) for r in found.orderBy("path").toLocalIterator()) + "]"
        return render.json_text(found) if isinstance(found, (dict, list)) else found

    def value(self, node: Any) -> Any:
        if isinstance(node, L.Literal):
            return node.value
        if isinstance(node, L.Call):
            return self.call(node)
        if isinstance(node, L.Var):
            return self.variable(node)
        if isinstance(node, L.Arith):
            return self.arith(node)
        if isinstance(node, L.Items):
            return [self.scalar(v) for v in node.values]
        if isinstance(node, L.Sorted):
            return self.sorted(node)
        if isinstance(node, L.PathOf):
            return self.path_value(self.resolved(node.segments))
        if isinstance(node, L.Shaped):
            base = self.resolved(node.base.segments)
            found = shaped(self.endpoints(), base, node.fields)
            if P.has_wildcards(base):
                return found
            row = found.first()
            if row is None:
                raise NotFound(P.text_of(base))
            return row["json"]
        if isinstance(node, L.Where) and isinstance(node.base, L.Call):
            return self.value(node.base).where(endpoint_conditions(self.filled(node.tree)))
        if isinstance(node, L.Where):
            base, tree = self.resolved(node.base.segments), conditions_of(self.filled(node.tree))
            ep = self.endpoints()
            if not self.compat:
                return entity.json(where.filtered(ep, base, tree))
            rows = entity.json(where.filtered(ep, base, tree, True), True).orderBy("entity")
            return "[" + ", ".join(f'"{r["json"]}"' for r in rows.toLocalIterator()) + "]"
        raise InvalidOperation("their stands outside a where")

    def path_value(self, segments: tuple[str, ...]) -> Any:
        if P.has_wildcards(segments):
            return scan.query(self.endpoints(), P.text_of(segments)).select("path", *V.VALUE_COLUMNS)
        path = P.text_of(segments)
        try:
            return self.get(path)
        except NotFound:
            try:
                return entity.reconstruct(self.endpoints(), path, self.compat)
            except InvalidOperation:
                if self.compat:
                    raise NotFound(path) from None
                raise

    def sorted(self, node: L.Sorted) -> DataFrame:
        """(place, entity, id, json) in the order of an attribute: numbers as numbers, then texts; entities without it last."""
        found = self.value(node.base)
        if not isinstance(found, DataFrame) or "entity" not in found.columns:
            raise InvalidOperation("sort takes a collection of entities")
        at = "$" + "".join(s if P.is_array_index(s) else f"['{s}']" for s in self.resolved(node.segments))
        by = F.get_json_object("json", at)
        order = [c.desc_nulls_last() if node.descending else c.asc_nulls_last() for c in (by.try_cast("double"), by)]
        return found.orderBy(*order, "entity").select(F.monotonically_increasing_id().alias("place"), "entity", "id", "json")

    def time(self, node: Any) -> datetime:
        text = self.scalar(node)
        try:
            at = datetime.fromisoformat(text)
        except (TypeError, ValueError):
            raise InvalidOperation(f"{text} is no time") from None
        return at if at.tzinfo else at.replace(tzinfo=UTC)

    def numbers(self, node: Any) -> list[float]:
        found = self.value(node)
        if not isinstance(found, list) or not found or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in found):
            raise InvalidOperation("A vector is a list of numbers")
        return found

    def one_number(self, named: dict[str, Any], name: str) -> int | float | None:
        return self.numbers(L.Items((named[name],)))[0] if name in named else None

    def past(self, node: L.Call) -> Any:
        """``history``: (seq, path, json) of a path's changes; ``snapshot``: an entity as it was.  Neither sees this query's own writes."""
        path, named = P.text_of(self.resolved(node.args[0].segments)), dict(node.named)
        if node.name == "history":
            rows = self.store.history(path, *(self.time(named[k]) if k in named else None for k in NAMED["history"]))
            told = F.concat(F.lit('{"seq":'), F.col("seq"), F.lit(',"deleted":'), F.col("deleted"), F.lit(',"value":'), V.json_column(), F.lit("}"))
            return rows.select("seq", "path", told.alias("json"))
        return entity.reconstruct(self.store.snapshot(self.one_number(named, "until"), self.time(named["as_of"]) if "as_of" in named else None), path, self.compat)

    def attribute_of(self, node: Any) -> tuple[str, str]:
        """Base and attribute of ``base.*.attribute``, given as a pattern or its text."""
        segments = self.resolved(node.segments) if isinstance(node, L.PathOf) else P.parse(str(self.scalar(node)))
        at = segments.index(P.ONE) if P.ONE in segments else 0
        if not 0 < at < len(segments) - 1 or P.has_wildcards(segments[:at] + segments[at + 1 :]):
            raise InvalidOperation("Expected a pattern base.*.attribute")
        return P.text_of(segments[:at]), P.text_of(segments[at + 1 :])

    def relation(self, node: L.Call) -> DataFrame:
        base, attribute = self.attribute_of(node.args[0])
        if node.name == "related_of_related":
            found = analysis.related_of_related(analysis.related(self.endpoints(), base, attribute))
            return found.select("id", "other", F.to_json(F.struct("id", "other", "n")).alias("json"))
        named = dict(node.named)
        limit, least = self.one_number(named, "limit"), self.one_number(named, "min_similarity")
        found = analysis.vector_search(self.endpoints(), base, attribute, self.numbers(node.args[1]), limit, -1.0 if least is None else least)
        return found.select(F.monotonically_increasing_id().alias("place"), F.concat(F.lit(base + "."), "id").alias("entity"), "id", F.to_json(F.struct("id", "similarity")).alias("json"))

    def call(self, node: L.Call) -> Any:
        if node.name in ("history", "snapshot"):
            return self.past(node)
        if node.name in ("vector_search", "related_of_related"):
            return self.relation(node)
        if node.name == "now":
            return datetime.now(UTC).isoformat()
        if node.name == "uuid":
            return str(uuids.uuid4())
        arg = node.args[0]
        if node.name == "days":
            n = self.scalar(arg)
            if isinstance(n, bool) or not isinstance(n, (int, float)):
                raise InvalidOperation("days takes a number")
            return timedelta(days=n)
        if isinstance(arg, L.PathOf):
            arg = L.PathOf(self.resolved(arg.segments))
        if node.name == "endpoints":
            return scan.query(self.endpoints(), P.text_of(arg.segments)).select("path", *V.VALUE_COLUMNS)
        if node.name in STATS:
            return analysis.attribute_stats(self.endpoints(), P.text_of(arg.segments)).first()[STATS[node.name]]
        if isinstance(arg, L.PathOf) and P.has_wildcards(arg.segments):
            return scan.query(self.endpoints(), P.text_of(arg.segments)).count()
        path = self.scalar(arg)
        if isinstance(arg, L.PathOf) and not self.compat and not isinstance(self.value(arg), str):
            path = P.text_of(arg.segments)
        if not isinstance(path, str):
            raise InvalidOperation("count takes the text of a path")
        return scan.count_prefix(self.endpoints(), P.text_of(P.parse(path))).first()[0]

    def run(self, query: L.Query) -> Any:
        for op in query.operations:
            if op[0] != "delete":
                check(op[2])
            if op[0] == "set":
                P.checked_path(P.text_of(op[1]))
        if query.result is not None:
            check(query.result)
        for op in query.operations:
            if op[0] == "let":
                self.variables[op[1]] = self.value(op[2])
                continue
            path = P.text_of(self.resolved(op[1]))
            if op[0] == "set":
                P.checked_path(path)
                self.writes[path] = (self.scalar(op[2]), False)
            else:
                self.get(path)
                self.writes[path] = (None, True)
            if self.compat:
                self.commit()
        result = True if query.result is None else self.value(query.result)
        self.commit()
        return result

    def commit(self) -> None:
        self.store.apply(self.writes)
        self.writes = {}


def execute(store, text: str) -> Any:
    """Runs a query: a Python value, or a DataFrame where the result is a collection."""
    return Run(store).run(L.parse(text, store.compat))
