"""Values, entities and paths as text, JSON and tables; small results, on the driver."""

from __future__ import annotations

import json
import math
from decimal import Decimal
from typing import Any

from waypost.errors import InvalidOperation
from waypost.functions import values as V


def number_text(x: float) -> str:
    """A float without an exponent: 3 for 3.0, all digits that tell it from its neighbours."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    out = format(Decimal(repr(x)), "f")
    return out.rstrip("0").rstrip(".") if "." in out else out


def text_value(value: Any) -> str:
    """A value as text; strings are quoted but not escaped."""
    if isinstance(value, V.Binary):
        return f"[binary data: {value.mime}]" if value.mime else "[binary data]"
    if isinstance(value, V.Reference):
        return f"@{value.path}"
    if isinstance(value, str):
        return f'"{value}"'
    if isinstance(value, float):
        return number_text(value)
    return {None: "null", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else str(value)


def pretty(tree: Any, indent: int = 0) -> str:
    """A nested entity, two spaces a level, keys in order."""
    pad, inner = " " * indent, " " * (indent + 2)
    if isinstance(tree, dict):
        body = ",\n".join(f'{inner}"{k}": {pretty(v, indent + 2)}' for k, v in sorted(tree.items()))
        return "{\n" + body + f"\n{pad}}}" if tree else "{}"
    if isinstance(tree, list):
        body = ",\n".join(inner + pretty(v, indent + 2) for v in tree)
        return "[\n" + body + f"\n{pad}]" if tree else "[]"
    return text_value(tree)


def plain(tree: Any) -> Any:
    """An entity as JSON data."""
    if isinstance(tree, dict):
        return {k: plain(v) for k, v in tree.items()}
    return [plain(v) for v in tree] if isinstance(tree, list) else V.value_to_json(tree)


def tagged(tree: Any) -> Any:
    """An entity as JSON data that names every type, as ``{"Integer": 1}``; null is ``"Null"``."""
    if isinstance(tree, dict):
        return {"Object": {k: tagged(v) for k, v in tree.items()}}
    if isinstance(tree, list):
        return {"Array": [tagged(v) for v in tree]}
    tag = V.tag_of(tree)
    if tag == "null":
        return "Null"
    if isinstance(tree, V.Binary):
        return {"Binary": [list(tree.data), tree.mime]}
    return {tag.capitalize(): tree.path if isinstance(tree, V.Reference) else tree}


def json_text(tree: Any, indent: int | None = None) -> str:
    return json.dumps(plain(tree), ensure_ascii=False, sort_keys=True, indent=indent, separators=(",", ": " if indent else ":"))


def table(header: list[str], rows: list[list[str]]) -> str:
    widths = [max(len(str(r[i])) for r in [header, *rows]) for i in range(len(header))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "| " + " | ".join(str(x).ljust(w) for x, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([rule, line(header), rule, *(x for r in rows for x in (line(r), rule))])


def kind_of(x: Any) -> str:
    return "object" if isinstance(x, dict) else "array" if isinstance(x, list) else V.tag_of(x)


def render(what: Any, form: str = "text") -> str:
    """A value or entity in one of the forms text, json and table."""
    if form == "json":
        return json_text(what, 2)
    if form == "text":
        return pretty(what)
    if form != "table":
        raise InvalidOperation(f"No such format: {form}")
    short = lambda v: f"{{{len(v)}}}" if isinstance(v, dict) else f"[{len(v)}]" if isinstance(v, list) else text_value(v)
    if isinstance(what, dict):
        return table(["Path", "Type", "Value"], [[k, kind_of(v), short(v)] for k, v in sorted(what.items())])
    if isinstance(what, list):
        return table(["Index", "Type", "Value"], [[str(i), kind_of(v), short(v)] for i, v in enumerate(what)])
    return table(["Type", "Value"], [[kind_of(what), text_value(what)]])


def render_paths(paths: list[str], form: str = "text") -> str:
    if form == "json":
        return json.dumps(paths, indent=2)
    return table(["Index", "Path"], [[str(i), p] for i, p in enumerate(paths)]) if form == "table" else "\n".join(paths)


def render_message(kind: str, text: str, form: str = "text") -> str:
    """``kind``: error, info or success."""
    return json.dumps({kind: text}, indent=2) if form == "json" else f"{kind.capitalize()}: {text}"
