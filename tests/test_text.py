"""What is done with a pipeline's text before Spark sees it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import Cap, Operator, PermissionDenied, Policy, QueryError, ReadOnlyError, SchemaError
from millrace.functions.text import CharEmbedder, Embedding, term_lists, tokenize, unlisted
from millrace.operators.base import Middle, take, words_of
from millrace.operators.builtins import BUILTINS, Grep, Sh
from millrace.operators.registry import Registry
from millrace.plans.dialect import portable_regex, translate
from millrace.plans.guard import check_read
from millrace.plans.lex import placeholders, split_pipeline
from millrace.schema import parse_schema


@pytest.mark.parametrize(
    "text, stages",
    [
        ("SELECT 1", ["SELECT 1"]),
        ("scan t | SELECT a || 'x|y' FROM _in", ["scan t", "SELECT a || 'x|y' FROM _in"]),
        ("scan t | grep 'a|b' --field c | SELECT \"p|q\" FROM _in -- a | b", ["scan t", "grep 'a|b' --field c", "SELECT \"p|q\" FROM _in -- a | b"]),
        ("SELECT 'it''s | here' | sh 'cat'", ["SELECT 'it''s | here'", "sh 'cat'"]),
    ],
)
def test_split(text, stages):
    assert split_pipeline(text) == stages


@pytest.mark.parametrize("text", ["", "scan t |", "| SELECT 1", "a | | b"])
def test_empty_stage(text):
    with pytest.raises(QueryError):
        split_pipeline(text)


def test_placeholders():
    assert placeholders("a = ? AND b = '?' AND \"?\" = ? -- ?\n /* ? */") == 2


def test_dialect():
    assert translate("SELECT a FROM t ORDER BY a, b DESC LIMIT 3") == "SELECT a FROM t ORDER BY a NULLS LAST, b DESC NULLS LAST LIMIT 3"
    assert "NULLS FIRST" in (s := translate("SELECT a FROM t ORDER BY a NULLS FIRST")) and "LAST" not in s
    assert "/(60+n)" in translate("SELECT 1.0/(60+n)") and "1.0D" in translate("SELECT 1.0/(60+n)")
    assert portable_regex("[[:digit:]]+") == "[0-9]+"
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1"):
        with pytest.raises(QueryError):
            portable_regex(bad)


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t", "DROP TABLE t", "CREATE TABLE x (a INT)", "ALTER TABLE t ADD COLUMN b INT", "TRUNCATE TABLE t", "COPY t TO 'x'", "ATTACH 'x' AS y",
        "CALL f()", "SET a = 1", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM t INSERT INTO a SELECT *", "SELECT reflect('java.lang.System', 'exit', 1)",
        "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1", "CACHE TABLE t", "ADD JAR 'x'", "EXPLAIN SELECT 1", "SELECT java_method('a', 'b')",
    ],
)
def test_only_reads(spark, sql):
    with pytest.raises(ReadOnlyError):
        check_read(spark, sql, translate(sql))


@pytest.mark.parametrize("sql", ["SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "VALUES (1)", "SELECT * FROM t WHERE a IN (SELECT b FROM u)", "SHOW TABLES", "SELECT a, sum(b) FROM t GROUP BY CUBE (a) HAVING sum(b) > 1 ORDER BY 1 LIMIT 3", "SELECT 'DELETE FROM t'"])
def test_reads(spark, sql):
    check_read(spark, sql, translate(sql))


def test_files_need_the_capability(spark):
    sql = "SELECT * FROM read_json('/tmp/x')"
    check_read(spark, sql, translate(sql), True)
    with pytest.raises(PermissionDenied):
        check_read(spark, sql, translate(sql), False)


def test_policy_order():
    assert Policy().authorize(Grep()) is None
    with pytest.raises(PermissionDenied):
        Policy().authorize(Sh())
    Policy("sandboxed").authorize(Sh())
    Policy(allowlist={"sh"}).authorize(Sh())
    with pytest.raises(PermissionDenied):
        Policy("trusted", deny={"SH"}, allowlist={"sh"}).authorize(Sh())
    with pytest.raises(PermissionDenied):
        Policy("trusted", deny_caps={Cap.EXEC}, allowlist={"sh"}).authorize(Sh())
    with pytest.raises(QueryError):
        Policy("other")


def test_registry():
    class Top(Middle):
        name = "top"

        def to_df(self, prev, args, ctx):
            return prev.limit(int(args.args[0]))

    class NoName(Operator):
        pass

    class Select(Top):
        name = "select"

    class Empty(Operator):
        name = "empty"

    r = Registry([*BUILTINS, Top])
    assert r.find("TOP") and not Top.is_source() and r.find("scan").is_source() and len(r.names()) == 8
    for bad in (NoName, Select, Empty, Top):
        with pytest.raises(QueryError):
            r.add(bad)


def test_arguments():
    assert words_of("grep 'a''b' --field c")[1] == "ab"
    assert take(["t", "--batch", "0"], "x", 1, batch=64, least_batch=1).batch == 1
    for bad in ([], ["a", "b"], ["a", "--k"], ["a", "--other", "1"], ["a", "--k", "z"]):
        with pytest.raises(QueryError):
            take(bad, "x", 1, k=1)
    with pytest.raises(QueryError):
        words_of("grep 'open")


def test_tokens():
    assert tokenize("Fix the PTY, tmux_2!") == ["fix", "the", "pty", "tmux_2"]
    assert tokenize("中文检索abc") == ["中文", "文检", "检索", "abc"] and tokenize("中") == ["中"] and tokenize(None) == []


OK = [{"table": "t", "columns": [{"name": "a", "type": "str"}], "primary": "a"}]


@pytest.mark.parametrize(
    "change",
    [
        {"primary": None}, {"primary": "z"}, {"columns": []}, {"columns": [{"name": "a", "type": "float"}]}, {"columns": [{"name": "ds", "type": "str"}]}, {"columns": [{"name": "a", "type": "blob"}]},
        {"columns": [{"name": "a", "type": "str"}, {"name": "d", "type": "decimal(2,5)"}]}, {"columns": [{"name": "a", "type": "str"}, {"name": "d", "type": "decimal(39,5)"}]}, {"searchable": ["z"]},
        {"columns": [{"name": "a", "type": "int"}], "searchable": ["a"]}, {"columns": [{"name": "a", "type": "str"}] * 2}, {"other": 1}, {"table": None},
    ],
)
def test_schemas_that_are_refused(change):
    assert parse_schema(OK)
    with pytest.raises(SchemaError):
        parse_schema([OK[0] | change])


def test_more_schemas_that_are_refused():
    for bad in ({}, [], [1], OK * 2):
        with pytest.raises(SchemaError):
            parse_schema(bad)


def test_texts_are_indexed_a_few_at_a_time(spark):
    """However many rows a batch has: a worker holds the tokens and vectors of a part of them."""

    class Sizes:
        dim = 2

        def embed(self, texts):
            return [[len(texts), sum(map(len, texts))]] * len(texts)

    rows = [(i, None if i % 50 == 0 else "é long text " * (1 + i % 40) if i else "x" * (3 << 20)) for i in range(1, 5000)] + [(5000, "y" * (3 << 20))]
    got = Embedding(Sizes()).index(spark.createDataFrame(rows, "id long, said string").coalesce(1), ("said",)).collect()
    assert [(r.id, r.said) for r in got] == rows and all((r._vec_said is None) == (r.said is None) for r in got)
    assert max(r._vec_said[0] for r in got if r.said) <= 1024 and max(r._vec_said[1] for r in got if r.said and r.id < 5000) <= 2 << 20
    assert all(r._tok_said == tokenize(r.said) for r in got if r.said)


def test_postings_are_counted_where_rows_lie(spark):
    rows = [(i, f"2024010{i % 3}", [f"w{j % (i + 2)}" for j in range(i % 17)]) for i in range(60)]
    made = spark.createDataFrame(rows, "key long, ds string, tok array<string>").withColumn("dl", F.size("tok")).coalesce(1)
    lists = term_lists(made)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    assert lists.count() == len({t for _, _, tok in rows for t in tok})
    want = sorted((t, k, len(tok), ds, tok.count(t)) for k, ds, tok in rows for t in set(tok))
    assert sorted(map(tuple, unlisted(lists).collect())) == want


def test_fast_paths_of_tokens_and_characters():
    texts = ["", "Plain words_here 12", "Ünïcode ñ", "混合 text 中文字 한국", "İ😀x", "\ud800a"]
    for t in texts:
        want = np.zeros(16, np.float32)
        for c in t:
            want[ord(c) % 16] += 1
        assert CharEmbedder().embed([t])[0] == want.tolist()
    assert tokenize(texts[3]) == ["混合", "text", "中文", "文字", "한국"] and tokenize(texts[1]) == ["plain", "words_here", "12"]
