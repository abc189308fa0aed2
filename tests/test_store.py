"""What the store reads and writes."""

from __future__ import annotations

import threading
import time
from concurrent.futures import Future

import pytest
from pyspark.sql import functions as F

from millrace import Port, QueryError
from millrace.functions.text import CharEmbedder
from millrace.plans.dialect import translate
from millrace.sources import store as stores
from millrace.tasks import Tasks

ITEMS = [{"table": "items", "columns": [{"name": "id", "type": "int"}, {"name": "said", "type": "str"}], "primary": "id", "searchable": ["said"]}]
PLAIN = [{**ITEMS[0], "searchable": []}]


@pytest.fixture
def items(spark, tmp_path):
    with Port.open(tmp_path, schema=ITEMS, embedder=CharEmbedder(), spark=spark) as p:
        yield p


def test_search_reads_postings_and_agrees_with_a_scan(items, spark, monkeypatch):
    rows = [{"id": i, "said": f"word{i % 7} and word{i % 11} {'rare ' * (i % 13 == 0)}"} for i in range(300)] + [{"id": 300, "said": None}, {"id": 301, "said": " "}]
    items.insert_df("items", spark.createDataFrame(rows, "id long, said string"))
    items.insert("items", [{"id": 400 + i, "said": "rare word3"} for i in range(5)])
    items.wait(items.delete("items", where="id % 26 = 0"))
    text = "search items 'rare word3' --k 20 | SELECT id, round(_score, 9) AS s FROM _in ORDER BY s DESC, id"
    got = items.query(text)
    plan = items.query_df(text)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [rare,word3])" in plan and "_tok_said" not in plan.split("post_said")[0].split("FileScan")[-1]
    monkeypatch.setattr(stores.Store, "postings", lambda *a: None)
    assert items.query(text) == got and len(got) == 20 and not [r for r in got if r["id"] % 26 == 0]


def test_compaction_keeps_what_there_is(items, tmp_path):
    for i in range(6):
        items.insert("items", {"id": i, "said": f"note {i} here"})
    items.wait(items.delete("items", where="id = 2"))
    text = "search items 'note here' | SELECT id, round(_score, 9) AS s FROM _in ORDER BY s DESC, id"
    rows, found = items.query("SELECT id, said, deleted_ds FROM _all_items ORDER BY id"), items.query(text)
    stats = items.wait(items.compact()).stats
    assert stats["files_after"] == 4 < stats["files_before"]
    assert items.query("SELECT id, said, deleted_ds FROM _all_items ORDER BY id") == rows and items.query(text) == found
    with pytest.raises(QueryError):
        items.insert("items", {"id": 2, "said": "again"})


def test_large_deletes_are_logged_by_the_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "DRIVER_KEYS", 10)
    with Port.open(tmp_path, schema=PLAIN, spark=spark) as p:
        p.insert_df("items", spark.range(100).select("id", F.lit("x").alias("said")))
        assert p.wait(p.delete("items", where="id < 50")).matched == 50
        assert p.wait(p.delete("items", where="id < 51")).matched == 1
        assert p.query("SELECT count(*) AS n FROM items") == [{"n": 49}]
        p.wait(p.rebuild())
        assert p.query("SELECT count(*) AS n, count(deleted_ds) AS gone FROM _all_items") == [{"n": 100, "gone": 51}]


def test_a_frame_that_changes_lands_as_it_was_checked(spark, tmp_path):
    with Port.open(tmp_path, schema=PLAIN, spark=spark) as p:
        p.insert_df("items", spark.range(50).select((F.col("id") + F.floor(F.rand() * 1000) * 100).cast("long").alias("id"), F.lit("x").alias("said")))
        p.insert_df("items", spark.range(50).select((F.col("id") + F.floor(F.rand() * 1000) * 100).cast("long").alias("id"), F.lit("y").alias("said")), skip_existing=True)
        r = p.query("SELECT count(*) AS n, count(DISTINCT id) AS ids FROM items")[0]
        assert r["n"] == r["ids"] >= 50
        assert not list(tmp_path.glob("derived/.staged-*")) and not list(tmp_path.glob("files/ds=*/.*jsonl*"))


def test_keys_are_looked_up_in_the_files_filters(spark, tmp_path):
    with Port.open(tmp_path, schema=PLAIN, spark=spark) as p:
        p.insert_df("items", spark.range(1000).select("id", F.lit("x").alias("said")))
        seen = []
        original = type(p.store).puts
        p.store.puts = lambda *a, **k: seen.append(original(p.store, *a, **k)) or seen[-1]
        with pytest.raises(QueryError):
            p.insert("items", [{"id": 5}, {"id": 5000}])
        plan = seen[0].where((F.col("id") == 5) | (F.col("id") == 5000))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [Or(EqualTo(id,5),EqualTo(id,5000))]" in plan


def test_tokenizers_and_awaitable_embedders(spark, tmp_path):
    class Later(CharEmbedder):
        async def embed(self, texts):
            return super().embed(texts)

    with Port.open(tmp_path, schema=ITEMS, embedder=Later(), spark=spark, tokenizer=lambda text: list(text)) as p:
        p.insert("items", [{"id": 1, "said": "abc"}, {"id": 2, "said": "xyz"}])
        assert [r["id"] for r in p.query("search items 'a' --k 1")] == [1]


def test_adopted_work_has_a_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("millrace.tasks.LIMIT_S", 0.2)
    tasks, future = Tasks(tmp_path, spark), Future()
    task = tasks.adopt("query", future, "SELECT 1", "no-such-group")
    time.sleep(0.6)
    assert tasks.get(task.id).state == "failed" and "0.2 s" in tasks.get(task.id).error
    threading.Thread(target=future.set_result, args=([],)).start()
    tasks.close()


def test_asof_join_in_sql(spark, tmp_path):
    with Port.open(tmp_path, schema=PLAIN, spark=spark) as p:
        v = lambda rows, names: f"(SELECT * FROM VALUES {rows} t({names}))"
        left, right = v("(1, 5), (1, 1), (2, 5), (1, NULL)", "k, t"), v("(1, 2, 'b'), (1, 5, 'e'), (1, 9, 'z'), (2, 6, 'q')", "k, t, x")
        ask = lambda how, on: [(r["k"], r["t"], r["x"]) for r in p.query(f"SELECT a.k, a.t, b.x FROM {left} a ASOF {how} {right} b {on} ORDER BY 1, 2, 3")]
        assert ask("LEFT JOIN", "ON a.k = b.k AND a.t >= b.t") == [(1, 1, None), (1, 5, "e"), (1, None, None), (2, 5, None)]
        assert ask("JOIN", "ON a.k = b.k AND a.t > b.t") == [(1, 5, "b")]
        assert ask("JOIN", "ON b.k = a.k AND a.t <= b.t") == [(1, 1, "b"), (1, 5, "e"), (2, 5, "q")]
        assert ask("JOIN", "ON a.k = b.k AND b.t > a.t") == [(1, 1, "b"), (1, 5, "z"), (2, 5, "q")]
        assert ask("JOIN", "USING (k, t)") == [(1, 5, "e")]
        assert ask("JOIN", "ON a.t >= b.t") == [(1, 5, "e"), (2, 5, "e")]
        assert p.query(f"SELECT * FROM {left} a ASOF JOIN (SELECT k AS k2, t AS t2, x FROM {right} r) b ON a.k = b.k2 AND a.t >= b.t2 WHERE x = 'e'") == [{"k": 1, "t": 5, "k2": 1, "t2": 5, "x": "e"}]
        assert p.query("SELECT asof FROM (SELECT 1 AS asof) t") == [{"asof": 1}]
        for wrong in (f"SELECT 1 FROM {left} a ASOF JOIN {right} b ON a.k = b.k", f"SELECT 1 FROM {left} ASOF JOIN {right} b ON a.t >= b.t"):
            with pytest.raises(QueryError):
                p.query(wrong)


def test_functions_of_lists_and_vectors(spark, tmp_path):
    with Port.open(tmp_path, schema=PLAIN, spark=spark) as p:
        r = p.query("SELECT len('abc') AS a, len(list_value(1, 2)) AS b, len(concat('x', 'y')) AS c, array_distance(list_value(0, 3), list_value(4, 0)) AS d, array_inner_product(list_value(1, 2), list_value(3, 4)) AS e, round(array_cosine_distance(list_value(1, 0), list_value(0, 2)), 6) AS f")
        assert r == [{"a": 3, "b": 2, "c": 2, "d": 5.0, "e": 11.0, "f": 1.0}]
    assert translate("SELECT len(x), len(y)", frozenset({1})) == "SELECT length(x), size(y)"


def test_jq_runs_a_partition_at_a_time_if_it_may():
    from millrace.operators.builtins import Jq

    jq = Jq()
    assert jq.by_row(jq.parse_args([".a | {b: .}"])) and not jq.by_row(jq.parse_args(["[., inputs]"])) and not jq.by_row(jq.parse_args(["limit(1; .a)"]))


def test_a_rebuild_writes_few_files_for_many_days(spark, tmp_path):
    """Not a file for each day in each task, nor 1 MB of filter in each; torn lines and repeated keys in the log are passed over."""
    import json

    for d in range(20):
        path = tmp_path / f"files/ds=202401{d + 1:02}/items.jsonl"
        path.parent.mkdir(parents=True)
        line = lambda i, said: json.dumps({"id": i, "said": said, "ds": path.parent.name[3:], "created_at": f"{d:02}"}) + "\n"
        path.write_text("".join(line(d * 50 + i, f"_deleted word{i} {'long ' * 4000}") for i in range(50)) + line(7, "again") + '[{"id": 5000, "said": "in a list"}]\n\n"text"\n{"id": 6000, "sa')
    (tmp_path / "files/ds=20240131").mkdir()
    (tmp_path / "files/ds=20240131/items.jsonl").write_text('{"_deleted": "3", "deleted_at": "x"}\n{"\\u005fdeleted": "4", "deleted_at": "y"}\n')
    with Port.open(tmp_path, schema=ITEMS, embedder=CharEmbedder(), spark=spark) as p:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            done = p.wait(p.rebuild())
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert done.state == "done" and done.stats["rows"] == 1000 and done.stats["tombstones"] == 2
        files = list(p.store.generation.rglob("puts/**/*.parquet"))
        assert len(files) < 8 * 20 * 0.7 and max(f.stat().st_size for f in files) < 400_000
        assert p.query("SELECT id FROM _all_items WHERE deleted_ds IS NOT NULL ORDER BY id") == [{"id": 3}, {"id": 4}]
        assert p.query("SELECT said FROM items WHERE id = 7")[0]["said"] != "again"
        assert len(p.query("search items 'word7' --k 30")) == 30
