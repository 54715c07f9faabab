"""Paths, patterns, and patterns as Catalyst predicates.

A path is a row of segments joined by dots; a segment is a name or an index
``[n]``.  In a pattern ``*`` stands for one segment and ``**`` for any number.
``compat`` keeps the behaviour of an older store: ``**`` ignores what stands
before it, and ``tags[0]`` is one name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waypost.errors import PathError

ONE, MANY = "*", "**"
_INDEX = re.compile(r"\[\+?(\d+)\]")
_SUFFIXED = re.compile(r"(.+?)((?:\[\+?\d+\])+)")


def parse(text: str, compat: bool = False) -> tuple[str, ...]:
    """Segments of a path or pattern in canonical form: ``[007]`` is ``[7]``, ``tags[0]`` is ``tags``, ``[0]``."""
    if not text:
        raise PathError("Empty path")
    out: list[str] = []
    for part in text.split("."):
        if m := _INDEX.fullmatch(part):
            out.append(f"[{int(m[1])}]")
        elif not compat and (m := _SUFFIXED.fullmatch(part)):
            out += [m[1], *(f"[{int(i)}]" for i in _INDEX.findall(m[2]))]
        else:
            out.append(part)
    return tuple(out)


def text_of(segments: tuple[str, ...] | list[str]) -> str:
    return ".".join(segments)


def canonical(text: str) -> str:
    return text_of(parse(text))


def checked_path(text: str) -> tuple[str, ...]:
    """Segments of a path to store; wildcards are not data."""
    segments = parse(text)
    if has_wildcards(segments):
        raise PathError(f"A stored path holds no wildcard: {text}")
    return segments


def has_wildcards(segments: tuple[str, ...]) -> bool:
    return ONE in segments or MANY in segments


def is_array_index(segment: str) -> bool:
    return bool(_INDEX.fullmatch(segment))


def as_index(segment: str) -> int | None:
    m = _INDEX.fullmatch(segment)
    return int(m[1]) if m else None


def starts_with(path: tuple[str, ...], prefix: tuple[str, ...]) -> bool:
    """Segment by segment; a wildcard of the prefix stands for one segment."""
    return len(path) >= len(prefix) and all(p in (ONE, MANY, s) for p, s in zip(prefix, path, strict=False))


def matches(path: tuple[str, ...], pattern: tuple[str, ...], compat: bool = False) -> bool:
    """What ``matching`` computes, for one path on the driver."""
    return re.search(regex(pattern, compat), "." + text_of(path), re.DOTALL) is not None


def _quoted(segment: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\-])", r"\\\1", segment)


def regex(pattern: tuple[str, ...], compat: bool = False) -> str:
    """A regular expression for a dot and the text of a path; reads alike in Java and Python."""
    any_one = r"\.[^.]*"
    if compat and MANY in pattern:
        i = pattern.index(MANY)
        if i == len(pattern) - 1:
            return r"^[\s\S]*$"
        return rf"^(?:{any_one}){{{i},}}" + regex(pattern[i + 1 :], True).removeprefix("^")
    parts = {ONE: any_one, MANY: rf"(?:{any_one})*"}
    return "^" + "".join(parts.get(s, r"\." + _quoted(s)) for s in pattern) + "$"


def _all(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates) if predicates else F.lit(True)


def below(prefix: str) -> Column:
    """At a path or under it, in a form that reaches the Parquet scan; the dot keeps ``u1`` from matching ``u10``."""
    return (F.col("path") == prefix) | F.col("path").startswith(prefix + ".")


def under(prefix: tuple[str, ...]) -> Column:
    """``starts_with`` as a predicate on endpoints."""
    literal = prefix[: next((i for i, s in enumerate(prefix) if s in (ONE, MANY)), len(prefix))]
    found = [F.col("root") == literal[0], below(text_of(literal))] if literal else []
    if len(literal) < len(prefix):
        found.append(F.col("depth") >= len(prefix))
        found += [F.get("segments", F.lit(i)) == s for i, s in enumerate(prefix) if i > len(literal) and s not in (ONE, MANY)]
    return _all(found)


def matching(pattern: tuple[str, ...], compat: bool = False) -> Column:
    """``matches`` as a predicate on endpoints.

    The exact test runs on the rows that cheap implied predicates leave: root
    prunes partitions, the literal head and the depth reach the Parquet scan.
    """
    if not has_wildcards(pattern):
        return (F.col("root") == pattern[0]) & (F.col("path") == text_of(pattern))
    head = pattern[: next(i for i, s in enumerate(pattern) if s in (ONE, MANY))]
    near = [F.col("root") == head[0], below(text_of(head))] if head else []
    if MANY not in pattern:
        fixed = [F.get("segments", F.lit(i)) == s for i, s in enumerate(pattern) if i >= len(head) and s != ONE]
        return _all([F.col("depth") == len(pattern), *near, *fixed])
    if compat:
        i = pattern.index(MANY)
        near = [] if i == len(pattern) - 1 else [F.col("depth") >= i]
    else:
        near.append(F.col("depth") >= len([s for s in pattern if s != MANY]))
    if tail := pattern[max(i for i, s in enumerate(pattern) if s in (ONE, MANY)) + 1 :]:
        near.append((F.col("path") == text_of(tail)) | F.col("path").endswith("." + text_of(tail)))  # cheaper than the expression, which runs on what is left
    return _all([*near, F.concat(F.lit("."), F.col("path")).rlike(regex(pattern, compat))])
