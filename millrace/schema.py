"""Declared tables: columns, types, primary key, searchable columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import QueryError, SchemaError

META = ("ds", "created_at", "deleted_ds", "deleted_at")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_DECIMAL = re.compile(r"decimal\((\d+),(\d+)\)\Z")
_SIMPLE = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "timestamptz": T.TimestampType(), "json": T.StringType()}
_KNOWN = {"table", "columns", "primary", "searchable"}


@dataclass(frozen=True)
class Column:
    name: str
    type: str

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.type)


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Column, ...]
    primary: str
    searchable: tuple[str, ...] = ()

    @property
    def business(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark) for c in self.columns])

    @property
    def stored(self) -> T.StructType:
        """Columns of a put: the business columns, tokens and vectors of the searchable ones, and when it was made."""
        fields = list(self.business.fields)
        for c in self.searchable:
            fields += [T.StructField(f"_tok_{c}", T.ArrayType(T.StringType())), T.StructField(f"_vec_{c}", T.ArrayType(T.FloatType()))]
        return T.StructType([*fields, T.StructField("created_at", T.StringType()), T.StructField("ds", T.StringType())])

    @property
    def visible(self) -> list[str]:
        return [*(c.name for c in self.columns), *META]


@dataclass(frozen=True)
class Schema:
    tables: tuple[TableSpec, ...]

    def table(self, name: str) -> TableSpec:
        for t in self.tables:
            if t.name == name:
                return t
        raise QueryError(f"there is no table {name!r}")


def spark_type(kind: str) -> T.DataType:
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    m = _DECIMAL.match(kind)
    if m and 0 < int(m[1]) <= 38 and int(m[2]) <= int(m[1]):
        return T.DecimalType(int(m[1]), int(m[2]))
    raise SchemaError(f"unknown type {kind!r}")


def _columns(name: str, declared) -> tuple[Column, ...]:
    if not isinstance(declared, (list, tuple)) or not declared:
        raise SchemaError(f"{name}: columns has to be a list with a column at least")
    out: list[Column] = []
    for c in declared:
        if not isinstance(c, dict) or set(c) != {"name", "type"} or not isinstance(c["name"], str) or not IDENTIFIER.match(c["name"]):
            raise SchemaError(f"{name}: a column is a name and a type, not {c!r}")
        if c["name"] in META or c["name"].startswith(("_vec_", "_tok_")):
            raise SchemaError(f"{name}: {c['name']} is kept for the engine")
        if c["name"] in {o.name for o in out}:
            raise SchemaError(f"{name}: column {c['name']} comes twice")
        spark_type(c["type"])
        out.append(Column(c["name"], c["type"]))
    return tuple(out)


def parse_schema(declared) -> Schema:
    """Check a list of table declarations; SchemaError for whatever is wrong."""
    if not isinstance(declared, (list, tuple)) or not declared:
        raise SchemaError("a schema is a list of tables, one at least")
    tables: dict[str, TableSpec] = {}
    for d in declared:
        if not isinstance(d, dict) or not isinstance(d.get("table"), str) or not IDENTIFIER.match(d["table"]):
            raise SchemaError("every table needs a name")
        name = d["table"]
        if set(d) - _KNOWN:
            raise SchemaError(f"{name}: unknown keys {sorted(set(d) - _KNOWN)}")
        if name in tables:
            raise SchemaError(f"table {name} comes twice")
        columns = _columns(name, d.get("columns"))
        types = {c.name: c.type for c in columns}
        if types.get(d.get("primary")) not in ("str", "int"):
            raise SchemaError(f"{name}: primary has to name a str or int column")
        searchable = tuple(d.get("searchable") or ())
        for c in searchable:
            if types.get(c) != "str":
                raise SchemaError(f"{name}: searchable column {c!r} has to be a declared str")
        tables[name] = TableSpec(name, columns, d["primary"], searchable)
    return Schema(tuple(tables.values()))
