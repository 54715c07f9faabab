"""Errors of the engine."""


class WaypostError(Exception):
    """Any error the engine raises on purpose."""


class PathError(WaypostError):
    """A path or pattern that can't be read."""


class NotFound(WaypostError):
    """No endpoint at a path, or none below it."""


class InvalidOperation(WaypostError):
    """A query that can't be analysed, or values that can't be compared or nested."""
