"""What can go wrong, and how it travels over HTTP."""

from __future__ import annotations


class MillraceError(Exception):
    """Any failure of this library."""

    status = 400


class Unavailable(MillraceError):
    """The store can't be opened or served now."""

    status = 503


class SchemaError(MillraceError):
    """The declared tables are not valid."""


class EmbedderInvalid(MillraceError):
    """An embedder is needed and missing, or doesn't do what it declares."""


class ReadOnlyError(MillraceError):
    """A statement that isn't a read."""


class QueryError(MillraceError):
    """A query, write or pipeline that can't be understood or carried out."""


class PermissionDenied(MillraceError):
    """An operator needs what the policy doesn't grant."""

    status = 403


class NotFound(MillraceError):
    """No such task."""

    status = 404


BY_NAME = {c.__name__: c for c in (MillraceError, Unavailable, SchemaError, EmbedderInvalid, ReadOnlyError, QueryError, PermissionDenied, NotFound)}


def to_wire(e: Exception) -> tuple[int, dict]:
    known = isinstance(e, MillraceError)
    return (e.status if known else 500), {"error": {"type": type(e).__name__ if known else "Internal", "message": str(e)}}


def from_wire(error: dict) -> MillraceError:
    return BY_NAME.get(error.get("type", ""), MillraceError)(error.get("message", ""))
