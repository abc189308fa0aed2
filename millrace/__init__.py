"""A data port on Spark: read-only pipelines over declared, insert-only tables."""

from .errors import EmbedderInvalid, MillraceError, NotFound, PermissionDenied, QueryError, ReadOnlyError, SchemaError, Unavailable
from .operators.base import Cap, Context, Operator
from .operators.policy import Policy
from .port import Port
from .tasks import Task

__all__ = ["Cap", "Context", "EmbedderInvalid", "MillraceError", "NotFound", "Operator", "PermissionDenied", "Policy", "Port", "QueryError", "ReadOnlyError", "SchemaError", "Task", "Unavailable"]
