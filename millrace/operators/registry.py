"""Operators by name."""

from __future__ import annotations

from ..errors import QueryError
from .base import Operator

#: Words that begin a SQL stage; no operator may be called so.
KEYWORDS = {"select", "with", "from", "values", "table", "show", "describe", "summarize", "explain", "pivot", "unpivot", "call", "pragma"}


class Registry:
    def __init__(self, operators: list[type[Operator]] = ()):
        self._by_name: dict[str, Operator] = {}
        for o in operators:
            self.add(o)

    def add(self, operator: type[Operator] | Operator) -> None:
        one = operator() if isinstance(operator, type) else operator
        name = (one.name or "").lower()
        if not name:
            raise QueryError("an operator needs a name")
        if name in KEYWORDS:
            raise QueryError(f"{name} is a word of SQL")
        if name in self._by_name:
            raise QueryError(f"operator {name} is there already")
        if one.bounded and not one.sink and not (one.has("to_df") or one.has("to_argv")):
            raise QueryError(f"operator {name} has neither to_df nor to_argv")
        self._by_name[name] = one

    def find(self, word: str) -> Operator | None:
        return self._by_name.get(word.lower())

    def names(self) -> list[str]:
        return sorted(self._by_name)
