"""What an operator is: a named stage that makes a DataFrame, or a process that rows are piped through."""

from __future__ import annotations

import inspect
import shlex
from dataclasses import dataclass
from enum import Enum
from types import SimpleNamespace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError


class Cap(str, Enum):
    PURE = "pure"
    FS_READ = "fs_read"
    FS_WRITE = "fs_write"
    NET = "net"
    EXEC = "exec"


@dataclass
class Context:
    """What a stage may use: the request's session, the tables, the window of days."""

    spark: SparkSession
    store: Any
    embedding: Any = None
    ds_start: str | None = None
    ds_end: str | None = None

    @property
    def schema(self):
        return self.store.schema


class Operator:
    """Subclass with a name and to_df(args, ctx) for a source, to_df(prev, args, ctx) for a middle, or to_argv(args) for a process."""

    name: str = ""
    caps: frozenset[Cap] = frozenset({Cap.PURE})
    bounded: bool = True
    sink: bool = False

    def parse_args(self, argv: list[str]) -> SimpleNamespace:
        positional, options = split_options(argv)
        return SimpleNamespace(args=positional, **options)

    def prepare(self, args: SimpleNamespace, ctx: Context) -> None:
        """Look things up once, before the plan is made."""

    @classmethod
    def has(cls, what: str) -> bool:
        return callable(getattr(cls, what, None))

    @classmethod
    def is_source(cls) -> bool:
        if cls.has("to_df"):
            return "prev" not in inspect.signature(cls.to_df).parameters
        return not cls.bounded


def words_of(stage: str) -> list[str]:
    """A stage's words by POSIX shell quoting: '' inside an argument, unlike in SQL, is nothing."""
    try:
        return shlex.split(stage, posix=True)
    except ValueError as e:
        raise QueryError(f"{stage!r}: {e}") from e


def split_options(argv: list[str]) -> tuple[list[str], dict[str, str]]:
    positional, options, rest = [], {}, list(argv)
    while rest:
        word = rest.pop(0)
        if word.startswith("--") and len(word) > 2:
            if not rest:
                raise QueryError(f"{word} needs a value")
            options[word[2:].replace("-", "_")] = rest.pop(0)
        else:
            positional.append(word)
    return positional, options


def take(argv: list[str], name: str, positional: int, **defaults) -> SimpleNamespace:
    """Exactly so many positional arguments, and the options in defaults; a default that is a number makes the option one, floored at least_<option>."""
    given, options = split_options(argv)
    if len(given) != positional:
        raise QueryError(f"{name} takes {positional} argument(s), not {len(given)}")
    floors = {k[6:]: defaults.pop(k) for k in list(defaults) if k.startswith("least_")}
    if set(options) - set(defaults):
        raise QueryError(f"{name} has no option --{sorted(set(options) - set(defaults))[0]}")
    out = dict(defaults)
    for key, value in options.items():
        if isinstance(defaults[key], int):
            try:
                out[key] = int(value)
            except ValueError as e:
                raise QueryError(f"{name}: --{key} is a whole number, not {value!r}") from e
        else:
            out[key] = value
    for key, least in floors.items():
        out[key] = max(least, out[key])
    return SimpleNamespace(given=given, **out)


class Source(Operator):
    def to_df(self, args: SimpleNamespace, ctx: Context) -> DataFrame:
        raise NotImplementedError


class Middle(Operator):
    def to_df(self, prev: DataFrame, args: SimpleNamespace, ctx: Context) -> DataFrame:
        raise NotImplementedError
