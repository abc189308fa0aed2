"""The engine's queries over the driver's tables, and SQL for the same rows."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .functions.joins import asof_join
from .functions.retrieval import best_matches, fuse, nearest
from .functions.text import CharEmbedder
from .operators.base import Context
from .operators.builtins import BUILTINS
from .operators.policy import Policy
from .operators.registry import Registry
from .plans.compile import build
from .port import Port
from .schema import parse_schema
from .sources.shared import scratch
from .sources.store import Frames

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
_KINDS = {"string": "str", "bigint": "int", "int": "int", "double": "float", "timestamp": "timestamptz", "timestamp_ntz": "timestamptz"}
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id"}
QUERIES: dict = {}
ORACLE_SQL: dict = {}
DAY, DELETED = "date_format(o_orderdate, 'yyyyMMdd')", "date_format(date_add(CAST(o_orderdate AS DATE), CAST(30 + o_orderkey % 60 AS INT)), 'yyyyMMdd')"
_LIFE = "SELECT *, strftime(o_orderdate, '%Y%m%d') AS ds, CASE WHEN o_orderstatus = 'F' THEN strftime(CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 60 AS INTEGER), '%Y%m%d') END AS deleted_ds FROM orders"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; orders with the days on which its rows were made and deleted, others always there."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    life = {"ds": F.expr(DAY), "deleted_ds": F.expr(f"CASE WHEN o_orderstatus = 'F' THEN {DELETED} END")} if name == "orders" else {"ds": F.lit("19700101"), "deleted_ds": F.lit(None).cast("string")}
    return df.withColumns(life)


def run(spark: SparkSession, sf_dir: str, text: str, tables: str, params: list | None = None, ds_start: str | None = None, ds_end: str | None = None, policy: Policy | None = None) -> DataFrame:
    """A pipeline over driver tables."""
    frames = {t: frame(spark, sf_dir, t) for t in tables.split()}
    schema = parse_schema([{"table": t, "primary": _KEYS[t], "columns": [{"name": c, "type": _KINDS[k]} for c, k in df.dtypes if c not in ("ds", "deleted_ds") and k in _KINDS]} for t, df in frames.items()])
    return build(text, params, Registry(BUILTINS), policy or Policy(), Context(spark, Frames(schema, frames), None, ds_start, ds_end))


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def pipeline(name: str, text: str, tables: str, oracle: str | None = None, **more) -> None:
    """The pipeline's own text is its SQL where both engines read it alike."""
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, text, tables, **more)
    ORACLE_SQL[name] = oracle or text


# days

_SHOW = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, ds, deleted_ds"
for _name, _days, _where in (
    ("scan_now", {}, "deleted_ds IS NULL"),
    ("scan_asof_end", {"ds_end": "19980601"}, "ds <= '19980601' AND (deleted_ds IS NULL OR deleted_ds > '19980601')"),
    ("scan_since_start", {"ds_start": "19970101"}, "deleted_ds IS NULL AND ds >= '19970101'"),
    ("scan_window", {"ds_start": "19970101", "ds_end": "19980601"}, "ds <= '19980601' AND (deleted_ds IS NULL OR deleted_ds > '19980601') AND ds >= '19970101'"),
):
    pipeline(_name, f"scan orders | SELECT {_SHOW} FROM _in", "orders", f"WITH o AS ({_LIFE}) SELECT {_SHOW} FROM o WHERE {_where}", **_days)
pipeline(
    "audit_created_window", "SELECT o_orderstatus, count(*) AS n, count(deleted_ds) AS n_deleted FROM _all_orders WHERE ds BETWEEN '19970101' AND '19971231' GROUP BY o_orderstatus", "orders",
    f"WITH o AS ({_LIFE}) SELECT o_orderstatus, count(*) AS n, count(deleted_ds) AS n_deleted FROM o WHERE ds BETWEEN '19970101' AND '19971231' GROUP BY o_orderstatus",
)
FLAGSHIP = "scan orders | grep '^[FO]$' --field o_orderstatus | SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM _in GROUP BY o_orderstatus"
pipeline(
    "scan_grep_sql", FLAGSHIP, "orders",
    f"WITH o AS ({_LIFE}) SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o WHERE ds <= '19980601' AND (deleted_ds IS NULL OR deleted_ds > '19980601') AND regexp_matches(o_orderstatus, '^[FO]$') GROUP BY o_orderstatus",
    ds_end="19980601",
)

# pipelines

pipeline("grep_text", "scan documents | grep 'th[aeiou]+.*\\.$' --field text | SELECT doc_id, lang FROM _in", "documents", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, 'th[aeiou]+.*\\.$')")
pipeline("grep_posix_class", "scan documents | grep '[[:digit:]]{3}' --field text | SELECT doc_id FROM _in", "documents", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[[:digit:]]{3}')")
pipeline("grep_cast_number", "scan orders | grep '77' --field o_orderkey | SELECT o_orderkey FROM _in", "orders", f"WITH o AS ({_LIFE}) SELECT o_orderkey FROM o WHERE deleted_ds IS NULL AND regexp_matches(CAST(o_orderkey AS VARCHAR), '77')")
pipeline("sql_leads_pipeline", "SELECT c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0 | SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM _in GROUP BY c_nationkey", "customer", "SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
pipeline("params_in_stages", "SELECT * FROM lineitem WHERE l_quantity > ? | SELECT l_returnflag || '?' AS flag, count(*) AS n FROM _in WHERE l_discount <= ? GROUP BY l_returnflag", "lineitem", "SELECT l_returnflag || '?' AS flag, count(*) AS n FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 GROUP BY l_returnflag", params=[30, 0.05])

# search

_TERMS, _K = ["that", "onesen", "der"], 100
_BM25 = """
t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != '')) AS term FROM documents),
dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('that', 'onesen', 'der') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))), 9) AS score
  FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY tf.doc_id)"""
_KNN = """
q AS (SELECT CAST(embedding AS DOUBLE[64]) AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS doc_id, round(array_cosine_distance(CAST(embedding AS DOUBLE[64]), q), 9) AS distance, label FROM embeddings, q)"""
_RANKS = """
a AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS r FROM v {where} QUALIFY r <= {cand}),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s {swhere} QUALIFY r <= {cand}),
h AS (SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL OUTER JOIN b USING (doc_id))"""


def _tokens(docs: DataFrame) -> DataFrame:
    split = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    return docs.select("doc_id", "lang", F.when(F.size(split) > 0, split).alias("tok"))


def _vectors(spark, sf_dir) -> tuple[DataFrame, list[float]]:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    return v, v.where("doc_id = 0").first()["embedding"]


def _nine(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.round(c, 9))


@query("bm25_topk", f"WITH {_BM25} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT {_K}")
def bm25_topk(spark, sf_dir):
    docs = _tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _nine(best_matches(docs, docs, "doc_id", "tok", _TERMS, _K), "score").drop("rank")


@query("knn_cosine_topk", f"WITH {_KNN} SELECT doc_id, distance FROM v ORDER BY distance, doc_id LIMIT {_K}")
def knn_cosine_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return _nine(nearest(v, "doc_id", "embedding", q, _K), "distance").drop("rank")


_KEYS["embeddings"] = "vec_id"


@query("knn_sql", "SELECT a.vec_id, round(array_cosine_distance(CAST(a.embedding AS DOUBLE[64]), CAST(q.embedding AS DOUBLE[64])), 9) AS cosine, round(array_distance(CAST(a.embedding AS DOUBLE[64]), CAST(q.embedding AS DOUBLE[64])), 6) AS straight FROM embeddings a, embeddings q WHERE q.vec_id = 0 ORDER BY cosine, a.vec_id LIMIT 100")
def knn_sql(spark, sf_dir):
    """Distances in a SQL stage; arrays are no declared type, so they come from a file."""
    path = f"{sf_dir}/embeddings.parquet"
    q = f"ARRAY({', '.join(map(repr, _vectors(spark, sf_dir)[1]))})"
    return run(spark, sf_dir, f"SELECT vec_id, round(array_cosine_distance(embedding, {q}), 9) AS cosine, round(array_distance(embedding, {q}), 6) AS straight FROM read_parquet('{path}') ORDER BY cosine, vec_id LIMIT 100", "region")


def _hybrid(spark, sf_dir, k: int, cand: int) -> DataFrame:
    docs = _tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    v, q = _vectors(spark, sf_dir)
    return _nine(fuse(nearest(v, "doc_id", "embedding", q, cand), best_matches(docs, docs, "doc_id", "tok", _TERMS, cand), "doc_id", k), "_score").withColumnRenamed("_score", "score")


_HYBRID = f"WITH {_BM25}, {_KNN}, " + _RANKS


@query("hybrid_rrf", _HYBRID.format(where="", swhere="", cand=100) + f" SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT {_K}")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, _K, _K)


@query("search_k_limit", _HYBRID.format(where="", swhere="", cand=5) + " SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 5")
def search_k_limit(spark, sf_dir):
    return _hybrid(spark, sf_dir, 5, 5)


@query("hybrid_filtered", _HYBRID.format(where="", swhere="", cand=100) + f", p AS (SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT {_K}) SELECT lang, count(*) AS n, round(max(score), 9) AS best FROM p JOIN documents USING (doc_id) WHERE n_chars > 200 GROUP BY lang")
def hybrid_filtered(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 200")
    return docs.join(F.broadcast(_hybrid(spark, sf_dir, _K, _K)), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.max("score"), 9).alias("best"))


# ports: folders of declared tables in the shared folder, written and read through the engine itself


def _folder(spark: SparkSession) -> Path:
    path = Path(scratch(spark).removeprefix("file://"))
    atexit.register(shutil.rmtree, path, True)
    path.mkdir(parents=True)
    return path


def _port(spark: SparkSession, folder: Path, *tables: dict, **more) -> Port:
    return Port.open(folder, schema=list(tables), spark=spark, **more)


def _declared(table: str, df: DataFrame, *searchable: str) -> dict:
    return {"table": table, "primary": _KEYS[table], "columns": [{"name": c, "type": _KINDS[k]} for c, k in df.dtypes], "searchable": list(searchable)}


_SAID = "that onesen der"
_FOUND = f"search documents '{_SAID}' --k {_K} | SELECT doc_id, lang, round(_score, 9) AS score FROM _in"
_CHARS = "list_transform(range(16), lambda k: CAST(len(list_filter(string_split({0}, ''), lambda c: unicode(c) % 16 = k)) AS DOUBLE))"
#: What search does, from the texts: tokens and characters' counts, statistics of all rows, candidates of the window ws.
_SEARCH = f"""
d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+(?:_[\\p{{L}}\\p{{N}}]+)*') AS tok, CAST({_CHARS.format("text")} AS DOUBLE[16]) AS vec,
  strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y%m%d') AS ds, CASE WHEN doc_id % 5 = 0 THEN strftime(DATE '2024-01-11' + CAST(doc_id % 28 AS INTEGER), '%Y%m%d') END AS deleted_ds FROM documents WHERE trim(coalesce(text, '')) != ''),
t AS (SELECT doc_id, unnest(tok) AS term, len(tok) AS dl FROM d), st AS (SELECT count(*) AS n, CAST(sum(len(tok)) AS DOUBLE) / count(*) AS av FROM d),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM t WHERE term IN ('that', 'onesen', 'der') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ws AS (SELECT * FROM d WHERE {{window}}),
s AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))), 12) AS score
  FROM tf JOIN df USING (term) JOIN ws USING (doc_id) CROSS JOIN st GROUP BY doc_id),
v AS (SELECT doc_id, round(array_cosine_distance(vec, CAST({_CHARS.format("'" + _SAID + "'")} AS DOUBLE[16])), 12) AS distance FROM ws),
""" + _RANKS.format(where="", swhere="", cand="{cand}").lstrip() + f", p AS (SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT {_K}) SELECT doc_id, lang, score FROM p JOIN documents USING (doc_id)"


@query("port_search", "WITH " + _SEARCH.replace("{window}", "true").replace("{cand}", "100"))
def port_search(spark, sf_dir):
    """Documents inserted into a port, and searched there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    with _port(spark, _folder(spark), _declared("documents", docs, "text"), embedder=CharEmbedder()) as port:
        port.insert_df("documents", docs)
        return port.query_df(_FOUND)


def _logged(spark, sf_dir) -> Path:
    """A port's folder with nothing but its log: documents put on 28 days, a fifth of them deleted ten days later."""
    folder = _folder(spark)
    day = lambda first: F.date_format(F.date_add(F.lit(first).cast("date"), (F.col("doc_id") % 28).cast("int")), "yyyyMMdd")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", day("2024-01-01").alias("ds"), F.lit("2024-01-01T00:00:00+00:00").alias("created_at"))
    gone = docs.where("doc_id % 5 = 0").select(day("2024-01-11").alias("day"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("_deleted"), F.col("created_at").alias("deleted_at"))).alias("value"))
    lines = docs.select(F.col("ds").alias("day"), F.to_json(F.struct("doc_id", "text", "lang", "ds", "created_at"), {"ignoreNullFields": "false"}).alias("value"))
    lines.union(gone).write.partitionBy("day").text(str(folder / "lines"))
    for d in (folder / "lines").glob("day=*"):
        (folder / "files" / f"ds={d.name[4:]}").mkdir(parents=True)
        os.replace(d, folder / "files" / f"ds={d.name[4:]}" / f"documents.jsonl-{uuid.uuid4().hex}")
    return folder


def _rebuilt(spark, sf_dir) -> Port:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    port = _port(spark, _logged(spark, sf_dir), _declared("documents", docs, "text"), embedder=CharEmbedder())
    done = port.wait(port.rebuild())
    if done.state != "done":
        raise RuntimeError(done.error)
    return port


@query("hybrid_asof", "WITH " + _SEARCH.replace("{window}", "ds <= '20240115' AND (deleted_ds IS NULL OR deleted_ds > '20240115')").replace("{cand}", "400"))
def hybrid_asof(spark, sf_dir):
    """A port rebuilt from its log, searched as of a day: candidates are of that day, the words' statistics of all rows."""
    with _rebuilt(spark, sf_dir) as port:
        return port.query_df(_FOUND, ds_end="20240115")


@query("port_rebuild", "SELECT lang, strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y%m%d') AS ds, count(*) AS n, count(CASE WHEN doc_id % 5 = 0 THEN 1 END) AS n_deleted, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def port_rebuild(spark, sf_dir):
    """All rows that a rebuild makes of the log, compacted, with those that tombstones delete."""
    with _rebuilt(spark, sf_dir) as port:
        port.wait(port.compact())
        return port.query_df("SELECT lang, ds, count(*) AS n, count(deleted_ds) AS n_deleted, sum(length(text)) AS chars FROM _all_documents GROUP BY lang, ds")


@query("port_skip_existing", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE o_orderpriority END AS o_orderpriority, o_totalprice FROM main.orders")
def port_skip_existing(spark, sf_dir):
    """Keys that are there already are left out, and of keys that a batch repeats the first stays."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    with _port(spark, _folder(spark), _declared("orders", orders)) as port:
        port.insert_df("orders", orders.where("o_orderstatus = 'F'").withColumn("o_orderpriority", F.lit("first")))
        port.insert_df("orders", orders.union(orders), skip_existing=True)
        return port.query_df("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")


@query("port_delete", "SELECT o_orderkey, o_totalprice > 150000 AS deleted FROM main.orders")
def port_delete(spark, sf_dir):
    """Deleted rows stay, marked; a second delete of the same finds none."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    with _port(spark, _folder(spark), _declared("orders", orders)) as port:
        port.insert_df("orders", orders)
        for again in (False, True):
            n = port.wait(port.delete("orders", where="o_totalprice > ?", params=[150000])).matched
            if again and n:
                raise RuntimeError(f"{n} rows were deleted twice")
        return port.query_df("SELECT o_orderkey, deleted_ds IS NOT NULL AND deleted_at IS NOT NULL AS deleted FROM _all_orders")


# writes

_BATCH = "SELECT e.*, (event_id * 7919) % 5000 AS k FROM events e"


def _batch(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", (F.col("event_id") * 7919) % 5000)


@query("batch_dedupe_first", f"WITH b AS ({_BATCH}) SELECT k, event_id, event_type FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id) = 1")
def batch_dedupe_first(spark, sf_dir):
    # the first of each key as an aggregate: combined before the shuffle, where a window would move every row
    return _batch(spark, sf_dir).groupBy("k").agg(F.min(F.struct("event_id", "event_type")).alias("r")).select("k", "r.event_id", "r.event_type")


@query("duplicate_keys", f"WITH b AS ({_BATCH}) SELECT k, count(*) AS n FROM b GROUP BY k HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return _batch(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n")).where("n > 1")


@query("skip_existing_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def skip_existing_anti(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").join(known, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("match_live", f"WITH o AS ({_LIFE}) SELECT CAST(o_orderkey AS VARCHAR) AS deleted FROM o WHERE deleted_ds IS NULL AND o_totalprice > 300000")
def match_live(spark, sf_dir):
    return run(spark, sf_dir, "SELECT CAST(o_orderkey AS STRING) AS deleted FROM orders WHERE o_totalprice > 300000", "orders")


@query("tombstone_apply", f"WITH o AS ({_LIFE}) SELECT o_orderkey, deleted_ds, deleted_ds IS NULL AS live FROM o WHERE ds >= '19970101'")
def tombstone_apply(spark, sf_dir):
    o = frame(spark, sf_dir, "orders")
    tombs = o.where("deleted_ds IS NOT NULL").select(F.col("o_orderkey").cast("string").alias("_deleted"), F.col("deleted_ds").alias("gone"))
    tombs = tombs.groupBy("_deleted").agg(F.min("gone").alias("gone"))
    j = o.where("ds >= '19970101'").join(tombs, F.col("o_orderkey").cast("string") == F.col("_deleted"), "left")
    return j.select("o_orderkey", F.col("gone").alias("deleted_ds"), F.col("gone").isNull().alias("live"))


@query("log_replay", "SELECT event_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events")
def log_replay(spark, sf_dir):
    """Rows as log lines and back again."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = e.select(F.to_json(F.struct("event_id", "event_type", "value", F.parse_json("props").alias("props")), {"ignoreNullFields": "false"}).alias("line"))
    return lines.select(F.from_json("line", "event_id long, event_type string, value double, props string").alias("r")).select("r.event_id", "r.event_type", "r.value", F.get_json_object("r.props", "$.k").alias("k"))


# processes

_TRUSTED = Policy(mode="sandboxed", process_timeout_s=300)
pipeline("jq_reshape", "scan customer | SELECT c_custkey, c_mktsegment, c_acctbal FROM _in | jq 'select(.c_acctbal > 5000) | {id: .c_custkey, segment: .c_mktsegment}'", "customer", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_acctbal > 5000", policy=_TRUSTED)
pipeline("sh_filter", "scan supplier | SELECT s_suppkey, s_name, s_nationkey FROM _in | sh 'grep \"s_nationkey.:1[0-9]\"' | SELECT s_nationkey, count(*) AS n FROM _in GROUP BY s_nationkey", "supplier", "SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey BETWEEN 10 AND 19 GROUP BY s_nationkey", policy=_TRUSTED)

# SQL stages

for _name, _tables, _sql in (
    ("join_inner", "customer nation", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    ("join_left", "customer lineitem", "SELECT c_custkey, count(l_orderkey) AS n FROM customer LEFT JOIN lineitem ON c_custkey = l_orderkey AND l_quantity > 40 GROUP BY c_custkey"),
    ("join_full", "customer supplier", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 50"),
    ("join_semi", "customer lineitem", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c_custkey AND l_returnflag = 'R')"),
    ("join_anti", "customer lineitem", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c_custkey AND l_returnflag = 'R')"),
    ("join_range", "part supplier", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 100 GROUP BY s_suppkey"),
    ("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    ("join_lateral", "nation customer", "SELECT n_name, x.top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey) x"),
    ("agg_group", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS mean, min(l_shipdate) AS first, max(l_tax) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"),
    ("agg_global", "lineitem", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem"),
    ("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag"),
    ("agg_filter", "lineitem", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY l_returnflag"),
    ("agg_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    ("agg_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    ("agg_grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    ("agg_having", "lineitem", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50"),
    ("win_rank", "customer", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)"),
    ("win_frame", "events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events"),
    ("qualify_top1", "customer", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1"),
    ("union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    ("union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    ("intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    ("except", "customer supplier", "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier"),
    ("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    ("cte_subquery", "orders customer", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_custkey, round(s, 2) AS total FROM customer JOIN big ON c_custkey = o_custkey WHERE s > (SELECT avg(s) FROM big)"),
    ("in_list", "nation", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_name IS NOT NULL"),
    ("fn_string", "customer", "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 3, 4) AS s, length(c_name) AS n, replace(c_name, '0', 'x') AS r, c_name || '|' || c_mktsegment AS both, regexp_matches(c_name, '9$') AS nine, starts_with(c_name, 'C') AS c, strpos(c_name, '#') AS at FROM customer"),
    ("fn_date", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS y, date_trunc('month', o_orderdate) = o_orderdate AS first, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS later FROM orders"),
    ("fn_math", "part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, floor(p_retailprice) % 7 = 0 AS m, abs(p_size - 25) AS a, round(ln(p_retailprice), 6) AS l, greatest(p_size, 25) AS g, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c FROM part"),
    ("fn_array", "documents", "SELECT lang, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(source, '[^a-z0-9]+')) AS part FROM documents) t GROUP BY lang"),
    ("fn_map", "nation", "SELECT n_nationkey, map_keys(MAP(list_value('key', 'region'), list_value(n_nationkey, n_regionkey))) AS k, map_values(MAP(list_value('key', 'region'), list_value(n_nationkey, n_regionkey))) AS v FROM nation"),
    ("fn_len", "documents", "SELECT doc_id, CAST(len(text) AS INTEGER) AS chars, CAST(len(string_split_regex(text, ' +')) AS INTEGER) AS words FROM documents"),
    ("agg_approx", "lineitem", "SELECT l_returnflag, abs(approx_count_distinct(l_linestatus) - count(DISTINCT l_linestatus)) < 1 AS near FROM lineitem GROUP BY l_returnflag"),
    ("range_table", "region", "SELECT r_name, x.id AS n FROM region CROSS JOIN range(3) x"),
    ("fn_json", "events", "SELECT event_type, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY event_type"),
):
    pipeline(_name, _sql, _tables, {"range_table": "SELECT r_name, x.range AS n FROM region CROSS JOIN range(3) x"}.get(_name) or ("WITH orders AS (SELECT * FROM (" + _LIFE.replace("FROM orders", "FROM main.orders") + ") WHERE deleted_ds IS NULL) " if "orders" in _tables.split() and not _sql.startswith("WITH") else "") + (_sql if not (_sql.startswith("WITH") and "orders" in _tables) else "WITH orders AS (SELECT * FROM (" + _LIFE.replace("FROM orders", "FROM main.orders") + ") WHERE deleted_ds IS NULL), " + _sql[5:]))

pipeline("sort_nulls_last", "SELECT k, c_custkey FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer) t ORDER BY k, c_custkey", "customer", "SELECT k, c_custkey FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer) t ORDER BY k, c_custkey")


@query("join_asof", "SELECT a.event_id, b.event_id AS last_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_asof(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_id"))
    return asof_join(e.where("event_type = 'purchase'"), clicks, ["user_id"], "ts", "ts", ["last_id"]).select("event_id", "last_id")


_ASOF = "SELECT a.event_id, b.event_id AS last_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts"
pipeline("asof_sql", _ASOF, "events")
pipeline("asof_sql_next", _ASOF.replace("a.ts >= b.ts", "b.ts > a.ts").replace("ASOF LEFT JOIN", "ASOF JOIN"), "events")


@query("stream_ingest_dedupe", "SELECT event_id, event_type FROM events")
def stream_ingest_dedupe(spark, sf_dir):
    """watch | jq | ingest over files of lines, those of a third of the keys replayed with another type: each key lands once, as it first came."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    lines = lambda df: df.select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("value"))
    lines(events).write.text(str(folder / "in/0"))
    lines(events.where("event_id % 3 = 0").withColumn("event_type", F.lit("replayed"))).write.text(str(folder / "in/1"))
    with _port(spark, folder, _declared("events", events), policy=_TRUSTED) as port:
        stream = port.stream(f"watch '{folder}/in/*/part-*' --poll-ms 20 | jq '{{event_id: .id, event_type: .kind}}' | ingest events --batch 20000 --flush-ms 20", name="events")
        stream.drain()
        stream.stop()
        return port.query_df("SELECT event_id, event_type FROM events")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return run(spark, sf_dir, FLAGSHIP, "orders", ds_end="19980601")


__all__ = ["ORACLE_SQL", "QUERIES", "Window", "entry", "run"]
