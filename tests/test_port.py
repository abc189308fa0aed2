"""A port's life, seen from outside."""

from __future__ import annotations

import json
import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace import EmbedderInvalid, NotFound, PermissionDenied, Policy, Port, QueryError, ReadOnlyError, Unavailable
from millrace.functions.text import BigramEmbedder, CharEmbedder
from millrace.http import RemotePort, serve
from millrace.operators.base import Middle

CARDS = [{"table": "cards", "columns": [{"name": "card_id", "type": "str"}, {"name": "issue", "type": "str"}, {"name": "kind", "type": "str"}, {"name": "n", "type": "int"}], "primary": "card_id", "searchable": ["issue"]}]
NOTES = [{"table": "notes", "columns": [{"name": "id", "type": "str"}, {"name": "text", "type": "str"}], "primary": "id"}]
ROWS = [{"card_id": "c1", "issue": "terminal flickers", "kind": "issue", "n": 1}, {"card_id": "c2", "issue": "draw a logo", "kind": "design", "n": 2}, {"card_id": "c3", "issue": "pty and tmux break in the terminal", "kind": "issue", "n": 3}]


@pytest.fixture
def cards(spark, tmp_path):
    with Port.open(tmp_path, schema=CARDS, embedder=CharEmbedder(), spark=spark, policy=Policy("sandboxed")) as p:
        p.insert("cards", ROWS)
        yield p


@pytest.fixture
def notes(spark, tmp_path):
    with Port.open(tmp_path, schema=NOTES, spark=spark) as p:
        yield p


def test_insert_query_delete_reopen(spark, tmp_path):
    with Port.open(tmp_path, schema=NOTES, spark=spark) as p:
        t = p.wait(p.insert("notes", [{"id": "a", "text": "one"}, {"id": "b"}]))
        assert (t.op, t.state) == ("insert", "done")
        assert p.query("SELECT id, text FROM notes ORDER BY id") == [{"id": "a", "text": "one"}, {"id": "b", "text": None}]
        assert p.wait(p.delete("notes", where="id = ?", params=["a"])).matched == 1
        assert p.wait(p.delete("notes", where="id = 'a'")).matched == 0
        assert p.query("SELECT id FROM notes") == [{"id": "b"}]
        assert p.query("SELECT count(*) AS n FROM _all_notes") == [{"n": 2}]
        with pytest.raises(QueryError):
            p.insert("notes", {"id": "a", "text": "again"})
    with pytest.raises(Unavailable):
        p.query("SELECT 1")
    with Port.open(tmp_path, schema=NOTES, spark=spark) as p:
        assert [r["id"] for r in p.query("SELECT id FROM notes")] == ["b"]
        lines = [json.loads(x) for f in (tmp_path / "files").glob("ds=*/notes.jsonl") for x in f.read_text().splitlines()]
        assert [set(x) for x in lines] == [{"id", "text", "ds", "created_at"}] * 2 + [{"_deleted", "deleted_at"}]


@pytest.mark.parametrize("rows", [{"id": "x", "other": 1}, [{"id": "x"}, {"id": "x"}], [{"text": "no key"}], [{"id": "x"}, {"id": None}]])
def test_a_bad_batch_leaves_nothing(notes, rows):
    with pytest.raises(QueryError):
        notes.insert("notes", rows)
    assert notes.query("SELECT * FROM notes") == []


def test_writes_and_nonsense_are_refused(notes):
    for sql in ("DELETE FROM notes", "SELECT 1; SELECT 2", "INSERT INTO notes VALUES ('a', 'b')"):
        with pytest.raises(ReadOnlyError):
            notes.query(sql)
    for sql in ("SELECT nope FROM notes", "SELEC 1", "scan nope", "scan notes | DELETE FROM notes", "scan notes | scan notes", "grep 'a' --field id", "watch '/x'", "scan notes | ingest notes"):
        with pytest.raises(QueryError):
            notes.query(sql)
    for where in ("", "id = 'a'; DROP TABLE notes", "id = ?", "nope = 1"):
        with pytest.raises(QueryError):
            notes.delete("notes", where=where)
    for sql, params in (("SELECT ?", []), ("SELECT 1", [1]), ("SELECT ? AS a | SELECT a, ? AS b FROM _in", [1])):
        with pytest.raises(QueryError):
            notes.query(sql, params=params)
    assert notes.query("SELECT ? AS a | SELECT a, ? AS b FROM _in", params=[1, "x"]) == [{"a": 1, "b": "x"}]


def test_types(spark, tmp_path):
    schema = [{"table": "t", "primary": "id", "columns": [{"name": "id", "type": "int"}, {"name": "amt", "type": "decimal(18,2)"}, {"name": "ts", "type": "timestamptz"}, {"name": "meta", "type": "json"}, {"name": "ok", "type": "bool"}, {"name": "x", "type": "float"}]}]
    with Port.open(tmp_path, schema=schema, spark=spark) as p:
        p.insert("t", {"id": 1, "amt": Decimal("12.30"), "ts": "2026-01-02T03:04:05+00:00", "meta": {"k": [1, 2]}, "ok": True, "x": 0.5})
        with pytest.raises(QueryError):
            p.insert("t", {"id": 2, "amt": "many"})
        want = [{"id": 1, "amt": Decimal("12.30"), "s": "2026-01-02 03:04:05", "k": "[1,2]", "ok": True, "x": 0.5}]
        sql = "SELECT id, amt, CAST(ts AS STRING) AS s, json_extract(meta, '$.k') AS k, ok, x FROM t"
        assert p.query(sql) == want
        assert p.wait(p.rebuild()).stats == {"tables": 1, "rows": 1, "tombstones": 0}
        assert p.query(sql) == want


def test_time_machine(notes, tmp_path):
    put = lambda ds, i: {"id": i, "text": "t", "ds": ds, "created_at": f"{ds}T"}
    for ds, lines in (("20260102", [put("20260102", "n1")]), ("20260104", [put("20260104", "n2"), put("20260104", "n1")]), ("20260105", [{"_deleted": "n1", "deleted_at": "x"}])):
        (tmp_path / "files" / f"ds={ds}").mkdir(parents=True)
        (tmp_path / "files" / f"ds={ds}" / "notes.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n\n{"id": "torn')
    assert notes.wait(notes.rebuild()).stats == {"tables": 1, "rows": 2, "tombstones": 1}
    seen = lambda **k: sorted(r["id"] for r in notes.query("SELECT id FROM notes", **k))
    assert [seen(ds_end=d) for d in ("20260101", "20260103", "20260104", "20260105", "20260106")] == [[], ["n1"], ["n1", "n2"], ["n2"], ["n2"]]
    assert seen() == ["n2"] and seen(ds_start="20260103") == ["n2"] and seen(ds_start="20260103", ds_end="20260104") == ["n2"] and seen(ds_start="20260105") == []
    for bad in ("2026-01-01", "x' OR 1=1", "202601"):
        with pytest.raises(QueryError):
            seen(ds_end=bad)
    notes.insert("notes", {"id": "n3", "text": "after a torn line"})
    assert notes.wait(notes.rebuild()).stats["rows"] == 3


def test_search(cards):
    hits = cards.query("search cards 'pty tmux terminal' | SELECT card_id, _score FROM _in ORDER BY _score DESC")
    assert hits[0]["card_id"] == "c3" and len(hits) == 3 and hits[0]["_score"] == pytest.approx(2 / 61)
    assert len(cards.query("search cards 'pty' --k 1")) == 1
    assert cards.query("search cards 'terminal' | grep '^term' --field issue | SELECT card_id, n FROM _in") == [{"card_id": "c1", "n": 1}]
    cards.delete("cards", where="card_id = 'c3'")
    assert {r["card_id"] for r in cards.query("search cards 'pty tmux terminal'")} == {"c1", "c2"}
    for bad in ("search cards", "search cards 'x' --k 0", "search cards 'x' --k z", "search cards 'x' --col n", "search nope 'x'"):
        with pytest.raises(QueryError):
            cards.query(bad)
    cols = list(cards.query("search cards 'logo' --k 1")[0])
    assert cols == ["card_id", "issue", "kind", "n", "ds", "created_at", "deleted_ds", "deleted_at", "_score"]


def test_chinese_search_null_texts_and_rebuild(spark, tmp_path):
    schema = [{"table": "notes", "primary": "id", "searchable": ["body"], "columns": [{"name": "id", "type": "str"}, {"name": "body", "type": "str"}]}]
    with pytest.raises(EmbedderInvalid):
        Port.open(tmp_path, schema=schema, spark=spark)
    with Port.open(tmp_path, schema=schema, embedder=BigramEmbedder(), spark=spark) as p:
        p.insert("notes", [{"id": "1", "body": "数据库全文检索"}, {"id": "2", "body": "周末去爬山"}, {"id": "3", "body": None}, {"id": "4", "body": ""}])
        best = p.query("search notes '全文检索' | SELECT id, _score FROM _in ORDER BY _score DESC")
        assert [r["id"] for r in best] == ["1", "2"]
        p.wait(p.rebuild())
        assert p.query("search notes '全文检索' | SELECT id, _score FROM _in ORDER BY _score DESC") == best


def test_processes(cards):
    assert cards.query("scan cards | SELECT card_id, n FROM _in ORDER BY n | sh 'head -1'") == [{"card_id": "c1", "n": 1}]
    assert cards.query("scan cards | jq 'select(.n > 1) | {id: .card_id, b: .n, a: 1}' | SELECT id, b + a AS s FROM _in ORDER BY id") == [{"id": "c2", "s": 3}, {"id": "c3", "s": 4}]
    assert list(cards.query("scan cards | jq '{z: .n, a: .card_id}'")[0]) == ["z", "a"]
    assert cards.query("scan cards | sh 'cat' | sh 'wc -l' | jq '{lines: .}'") == [{"lines": 3}]
    assert cards.query("scan cards | sh 'true'") == []
    for bad in ("sh 'exit 3'", "sh 'echo nope'", "jq '.['"):
        with pytest.raises(QueryError):
            cards.query(f"scan cards | {bad}")
    assert cards.explain("scan cards | sh 'cat' | SELECT 1") == ["scan: Catalyst", "sh: process", "sql: Catalyst"]


def test_process_timeout_and_policy(spark, tmp_path):
    with Port.open(tmp_path, schema=NOTES, spark=spark, policy=Policy("sandboxed", process_timeout_s=0.5)) as p:
        p.insert("notes", {"id": "a"})
        began = time.time()
        with pytest.raises(QueryError, match="stopped after"):
            p.query("scan notes | sh 'sleep 30'")
        assert time.time() - began < 20
    with Port.open(tmp_path, schema=NOTES, spark=spark) as p, pytest.raises(PermissionDenied):
        p.query("scan notes | sh 'cat'")


def test_own_operator(spark, tmp_path):
    class Top(Middle):
        name = "top"

        def to_df(self, prev, args, ctx):
            return prev.limit(int(args.args[0]))

    with Port.open(tmp_path, schema=NOTES, spark=spark, operators=[Top]) as p:
        p.insert("notes", [{"id": str(i)} for i in range(5)])
        assert len(p.query("scan notes | top 2")) == 2


def test_distributed_insert(notes, spark):
    frame = spark.range(1000).select(F.col("id").cast("string"), F.concat(F.lit("t"), "id").alias("text"))
    assert notes.wait(notes.insert_df("notes", frame)).stats == {"rows": 1000}
    with pytest.raises(QueryError):
        notes.insert_df("notes", frame)
    notes.insert_df("notes", frame.unionAll(frame).union(spark.createDataFrame([("new", "x")], "id string, text string")), skip_existing=True)
    count = lambda: notes.query("SELECT count(*) AS n, count(DISTINCT id) AS d FROM notes")
    assert count() == [{"n": 1001, "d": 1001}]
    assert notes.wait(notes.delete("notes", where="text LIKE 't9%'")).matched == 111
    notes.wait(notes.rebuild())
    assert count() == [{"n": 890, "d": 890}]


def test_tasks(notes):
    notes.insert("notes", [{"id": "a"}])
    t = notes.query("SELECT id FROM notes", as_task=True)
    assert notes.wait(t).rows == 1 and notes.task_result(t) == [{"id": "a"}]
    bad = notes.query("SELECT nope FROM notes", as_task=True)
    assert notes.wait(bad).state == "failed" and "QueryError" in notes.task_status(bad).error
    slow = notes.query("SELECT count(*) AS n FROM range(1000000) a CROSS JOIN range(1000000) b WHERE a.id * b.id % 7 = 1", as_task=True)
    while notes.task_status(slow).state == "pending":
        time.sleep(0.02)
    assert notes.cancel_task(slow).state == "cancelled" and notes.wait(slow).state == "cancelled"
    assert [x.id for x in notes.tasks(limit=2)] == [slow, bad] and len(notes.tasks()) == 4
    with pytest.raises(NotFound):
        notes.task_status("tk_20200101_000000000000")
    with pytest.raises(QueryError):
        notes.task_result(bad)


def test_concurrent_writes_and_reads(notes):
    failed = []

    def work(i):
        try:
            notes.insert("notes", {"id": str(i)})
            assert any(r["id"] == str(i) for r in notes.query("SELECT id FROM notes"))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and notes.query("SELECT count(*) AS n FROM notes") == [{"n": 6}]


def test_http(cards):
    server = serve(cards, api_key="k")
    try:
        r = RemotePort(f"http://127.0.0.1:{server.server_address[1]}", "k")
        assert r.ready and r.query("SELECT count(*) AS n FROM cards") == [{"n": 3}]
        r.insert("cards", {"card_id": "c4", "issue": "x"})
        assert r.wait(r.delete("cards", where="card_id = ?", params=["c4"])).matched == 1
        for error, sql in ((ReadOnlyError, "DELETE FROM cards"), (QueryError, "SELECT nope FROM cards")):
            with pytest.raises(error):
                r.query(sql)
        assert r.query("SELECT CAST(1.5 AS DECIMAL(3,1)) AS d, now() AS t")[0]["d"] == "1.5"
        task = r.query("SELECT count(*) AS n FROM range(3000000) a WHERE id % 7 = 1", wait_ms=0)
        assert r.wait(task).state == "done" and r.task_result(task)[0]["n"] > 0
        assert r.wait(r.rebuild()).state == "done" and len(r.tasks(limit=1)) == 1
        with pytest.raises(NotFound):
            r.task_status("tk_20200101_0")
        with pytest.raises(PermissionDenied):
            RemotePort(r.url, "wrong").query("SELECT 1")
        with pytest.raises(QueryError):
            r.stream("x", name="y")
    finally:
        server.shutdown()


def test_stream(cards, tmp_path):
    watched = tmp_path / "in"
    watched.mkdir()
    row = lambda i: json.dumps({"card_id": i, "issue": f"log {i}", "kind": "log", "n": 1}) + "\n"
    (watched / "a.jsonl").write_text(row("s1") + row("s2") + row("s1") + '{"card_id": "half')
    text = f"watch '{watched}/*.jsonl' --poll-ms 20 | ingest cards --batch 2 --flush-ms 20"
    h = cards.stream(text, name="s")
    with pytest.raises(QueryError):
        cards.stream(text, name="s")
    keys = lambda: sorted(r["card_id"] for r in cards.query("SELECT card_id FROM cards WHERE kind = 'log'"))

    def until(want):
        end = time.time() + 60
        while keys() != want and time.time() < end:
            time.sleep(0.3)
        assert keys() == want

    until(["s1", "s2"])
    h.stop()
    with (watched / "a.jsonl").open("a") as f:
        f.write('", "kind": "log"}\n' + row("s3"))
    h = cards.stream(text, name="s")
    until(["half", "s1", "s2", "s3"])
    (watched / "b.jsonl").write_text('{"msg": "boom", "level": "error"}\n')
    end = time.time() + 60
    while h.running and time.time() < end:
        time.sleep(0.2)
    assert not h.running and h.exception is not None
    for bad in ("ingest cards", f"watch '{watched}/x'", f"watch '{watched}/x' | SELECT 1 | ingest cards", f"watch '{watched}/x' | grep 'a' --field n | ingest cards", "scan cards | ingest cards", f"watch '{watched}/x' | ingest nope"):
        with pytest.raises(QueryError):
            cards.stream(bad, name="other")


def test_stream_reshapes(cards, tmp_path):
    (tmp_path / "raw.log").write_text("".join(json.dumps({"id": f"r{i}", "msg": "m", "level": "error" if i % 2 else "info"}) + "\n" for i in range(6)))
    h = cards.stream(f"watch '{tmp_path}/raw.log' | jq 'select(.level == \"error\") | {{card_id: .id, issue: .msg, kind: \"raw\"}}' | ingest cards", name="raw")
    end = time.time() + 60
    while len(cards.query("SELECT 1 FROM cards WHERE kind = 'raw'")) < 3 and time.time() < end:
        time.sleep(0.3)
    h.stop()
    assert [r["card_id"] for r in cards.query("SELECT card_id FROM cards WHERE kind = 'raw' ORDER BY card_id")] == ["r1", "r3", "r5"]


def test_a_stream_lands_all_that_is_there_at_once(spark, tmp_path):
    """Lines of many batches: few batches, and each key as it first came, by file and line."""
    schema = [{"table": "logs", "columns": [{"name": "id", "type": "int"}, {"name": "said", "type": "str"}], "primary": "id"}]
    line = lambda i, said: json.dumps({"id": i, "said": said}, ensure_ascii=False) + "\n"
    (tmp_path / "a.log").write_text("".join(line(i % 400, f"é{i}") for i in range(600)) + '{"id": 9')
    (tmp_path / "b.log").write_text("\n".join(line(i, "later") for i in range(500)))
    want = {i: f"é{i}" for i in range(400)} | {i: "later" for i in range(400, 500)}
    with Port.open(tmp_path / "p", schema=schema, spark=spark, policy=Policy(mode="sandboxed")) as p:
        h = p.stream(f"watch '{tmp_path}/*.log' --poll-ms 20 | jq '{{id: .id, said: .said}}' | ingest logs --batch 50 --flush-ms 20", name="s")
        h.drain()
        assert h.query.lastProgress["batchId"] <= 1
        with (tmp_path / "a.log").open("a") as f:
            f.write('99, "said": "x"}\n' + "".join(line(i, "new") for i in range(450, 560)))
        h.drain()
        h.stop()
        want |= {999: "x"} | {i: "new" for i in range(500, 560)}
        assert {r["id"]: r["said"] for r in p.query("SELECT id, said FROM _all_logs")} == want and p.query("SELECT count(*) AS n FROM logs") == [{"n": len(want)}]
        p.wait(p.rebuild())
        assert {r["id"]: r["said"] for r in p.query("SELECT id, said FROM logs")} == want
        files = len(list((tmp_path / "p/files").rglob("*.txt")))
        (tmp_path / "c.log").write_text("".join(line(i, "z") for i in range(600, 700)) + '{"id": "no number"}\n')
        h = p.stream(f"watch '{tmp_path}/*.log' --poll-ms 20 | ingest logs --batch 50 --flush-ms 20", name="s")
        with pytest.raises(Exception, match="fit its column"):
            h.drain()
        assert p.query("SELECT count(*) AS n FROM logs") == [{"n": len(want)}] and len(list((tmp_path / "p/files").rglob("*.txt"))) == files


def test_ranges_cut_within_lines_have_each_line_once(tmp_path, monkeypatch):
    from millrace.streaming.follow import FollowAllReader, FollowReader

    (tmp_path / "a.log").write_bytes("".join(f"é{'x' * (i % 9)}{i}\n" + "\n" * (i % 3) for i in range(80)).encode() + b"half")
    (tmp_path / "b.log").write_bytes(b"one\r\n" + b"y" * 50 + b"\n")
    for size in (1, 2, 7, 60, 10_000):
        monkeypatch.setattr("millrace.streaming.follow.RANGE", size)
        r = FollowAllReader(f"{tmp_path}/*.log")
        end, simple = r.latestOffset(), FollowReader(f"{tmp_path}/*.log", 1000).read({})
        rows = [x for part in r.partitions({}, end) for x in r.read(part)]
        assert [(x,) for x, _ in rows] == list(simple[0]) and end == simple[1] and [p for _, p in rows] == sorted({p for _, p in rows})
        cut = {str(tmp_path / "a.log"): len("é0\né".encode()) + 3}
        assert [(x,) for part in r.partitions(cut, end) for x, _ in r.read(part)] == list(FollowReader("", 0).readBetweenOffsets(cut, end))
    assert not r.partitions(end, end)
