"""Only reads pass: one statement, whose whole parsed tree is of kinds that read."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from ..errors import PermissionDenied, QueryError, ReadOnlyError
from .lex import leading_word, statements, tokens

_WRITES = {
    "INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "CREATE", "ALTER", "TRUNCATE", "ATTACH", "DETACH", "SET", "RESET", "CALL", "COPY", "EXPORT", "IMPORT", "PRAGMA", "INSTALL", "LOAD", "USE", "VACUUM",
    "ANALYZE", "CACHE", "UNCACHE", "CLEAR", "REFRESH", "ADD", "REPLACE", "GRANT", "REVOKE", "BEGIN", "COMMIT", "ROLLBACK", "EXPLAIN", "EXECUTE", "PREPARE", "DECLARE", "MSCK", "REPAIR", "COMMENT",
    "LOCK", "UNLOCK", "CHECKPOINT",
}
_READS = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Union", "Except", "Intersect", "Distinct", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedWith", "CTERelationDef", "UnresolvedHaving", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Generate", "WithWindowDefinition",
    "Window", "Pivot", "UnresolvedPivot", "Unpivot", "UnresolvedUnpivot", "Sample", "UnresolvedHint", "RepartitionByExpression", "Repartition", "ShowTables", "ShowColumns", "ShowNamespaces",
    "DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeFunction", "ShowFunctions", "UnresolvedSubqueryColumnAliases", "Transpose", "ResolvedInlineTable", "Range", "UnresolvedTableOrView",
    "UnresolvedOrderByAll", "UnresolvedNamespace", "CurrentNamespace", "NaturalJoin", "UsingJoin", "DeduplicateWithinWatermark", "Deduplicate", "AsOfJoin", "ShowViews", "ShowTablesExtended", "UnresolvedFunctionName",
    "NameParameterizedQuery", "PosParameterizedQuery", "ParameterizedQuery",
}
_FOREIGN = {"REFLECT", "JAVA_METHOD", "TRY_REFLECT"}


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _kinds(plan) -> set[str]:
    """Kinds of all nodes, those of CTE bodies included."""
    found, todo = set(), [plan]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName().rstrip("$")
        found.add(kind)
        todo += _seq(p.children())
        if kind == "UnresolvedWith":
            todo += [pair._2() for pair in _seq(p.cteRelations())] if p.cteRelations().size() else []
    return found


def check_read(spark: SparkSession, sql: str, translated: str, may_read_files: bool = True, refuse: type[Exception] = ReadOnlyError) -> None:
    """Raise refuse unless sql is one read; QueryError if it can't be parsed."""
    parts = statements(sql)
    if len(parts) != 1:
        raise refuse("one statement at a time") if parts else QueryError("there is no statement")
    if leading_word(parts[0]).upper() in _WRITES:
        raise refuse(f"{leading_word(parts[0]).upper()} isn't a read")
    used = {t.key.strip('`"').upper() for t in tokens(sql) if t.kind in ("word", "quoted", "tick")}
    if used & _FOREIGN:
        raise refuse(f"{sorted(used & _FOREIGN)[0].lower()} can't be called")
    if not may_read_files and re.search(r"\b(?:json|parquet|csv|orc|text|avro|binaryFile)\s*\.\s*`", translated, re.I):
        raise PermissionDenied("the policy doesn't allow files to be read")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(translated)
    except ParseException as e:
        raise QueryError(str(e).strip().split("\n")[0]) from e
    other = _kinds(plan) - _READS
    if other:
        raise refuse(f"not a read: {', '.join(sorted(other))}")
