"""A store in plain Python, to hold the engine against."""

from waypost.functions import paths as P
from waypost.functions.values import python_compare


def segment_match(pattern, path):
    """Documented matching, written as recursion over segments."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        return any(segment_match(pattern[1:], path[i:]) for i in range(len(path) + 1))
    return bool(path) and pattern[0] in ("*", path[0]) and segment_match(pattern[1:], path[1:])


def compat_match(pattern, path):
    """The older store's: what stands before the first ``**`` only counts."""
    if "**" not in pattern:
        return segment_match(pattern, path)
    i = pattern.index("**")
    if i == len(pattern) - 1:
        return True
    return any(compat_match(pattern[i + 1 :], path[k:]) for k in range(i, len(path) + 1))


def entity_ids(pairs, base, conditions, any_of=False):
    """Ids below a base for which conditions (relative path, op, literal) hold."""
    n, out = len(base), set()
    ids = {P.parse(p)[n] for p in pairs if len(P.parse(p)) > n and P.parse(p)[:n] == base}
    for i in ids:
        held = []
        for rel, op, value in conditions:
            at = ".".join((*base, i, *rel))
            held.append(at in pairs and python_compare(pairs[at], op, value))
        if (any if any_of else all)(held):
            out.add(i)
    return out
