"""Declared tables: a canonical JSONL log, and parquet derived from it."""

from __future__ import annotations

import datetime as dt
import functools
import json
import operator
import os
import re
import shutil
import uuid
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from ..errors import QueryError
from ..functions.text import listed, term_lists, unlisted
from ..schema import META, Schema, TableSpec

_DAY = re.compile(r"\d{8}\Z")
#: Keys up to which a batch is looked up key by key, and deleted rows up to which the driver writes their log itself.
EACH_KEY, DRIVER_KEYS = 500, 10_000


def now() -> tuple[str, str]:
    """(day, instant), both UTC."""
    t = dt.datetime.now(dt.timezone.utc)
    return t.strftime("%Y%m%d"), t.isoformat()


def check_days(*days: str | None) -> None:
    for d in days:
        if d is not None and not (isinstance(d, str) and _DAY.match(d)):
            raise QueryError(f"a day is YYYYMMDD, not {d!r}")


def window(ds_start: str | None, ds_end: str | None) -> Column:
    """Rows that are visible: live now, or as of the end of a day; made on a day or later."""
    check_days(ds_start, ds_end)
    ds, gone = F.col("ds"), F.col("deleted_ds")
    seen = (ds <= ds_end) & (gone.isNull() | (gone > ds_end)) if ds_end else gone.isNull()
    return seen & (ds >= ds_start) if ds_start else seen


def filtered(col: str) -> dict[str, str]:
    """Options for files with a filter of a column's values, as large as its values need: by default it is 1 MB in each file, however small."""
    return {f"parquet.bloom.filter.enabled#{col}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


class Frames:
    """Read-only tables from DataFrames that have their lifecycle columns already."""

    def __init__(self, schema: Schema, frames: dict[str, DataFrame]):
        self.schema, self.frames = schema, frames

    window = staticmethod(window)

    def physical(self, spark: SparkSession, name: str, hidden: bool = False) -> DataFrame:
        return self.frames[self.schema.table(name).name]

    def postings(self, spark: SparkSession, name: str, col: str) -> None:
        return None

    def visible(self, spark: SparkSession, name: str, ds_start: str | None = None, ds_end: str | None = None) -> DataFrame:
        return self.physical(spark, name).where(window(ds_start, ds_end)).select(*[c for c in self.schema.table(name).visible if c in self.frames[name].columns])


def _plain(v):
    if isinstance(v, Decimal):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    raise TypeError(f"{type(v).__name__} can't be written")


def _key(spec: TableSpec, names: list[str], r) -> object:
    """A row's key, if the row may be put."""
    if not isinstance(r, dict) or set(r) - set(names):
        raise QueryError(f"{spec.name}: unknown columns {sorted(set(r) - set(names)) if isinstance(r, dict) else r!r}")
    if r.get(spec.primary) is None:
        raise QueryError(f"{spec.name}: a row has no {spec.primary}")
    return r[spec.primary]


def objects(lines: list[str]) -> list[dict]:
    rows = []
    for x in lines:
        try:
            row = json.loads(x)
        except ValueError as e:
            raise QueryError(f"not JSON: {x[:200]!r}") from e
        if not isinstance(row, dict):
            raise QueryError(f"not a JSON object: {x[:200]!r}")
        rows.append(row)
    return rows


class Store:
    """files/ds=D/<t>.jsonl is the truth; derived/<generation>/<t>/{puts,tombs} follows from it. One writer at a time: the port holds a lock."""

    window = staticmethod(window)

    def __init__(self, root: Path, schema: Schema, spark: SparkSession, embedding=None):
        self.root, self.schema, self.spark, self.embedding = root, schema, spark, embedding
        self.files, self.derived = root / "files", root / "derived"
        for d in (self.files, self.derived):
            d.mkdir(parents=True, exist_ok=True)
        if not (self.derived / "CURRENT").exists():
            self._switch("gen-0")

    # derived tables

    @property
    def generation(self) -> Path:
        return self.derived / (self.derived / "CURRENT").read_text().strip()

    def _switch(self, name: str) -> None:
        new = self.derived / f".{uuid.uuid4().hex}"
        new.write_text(name)
        os.replace(new, self.derived / "CURRENT")

    def _read(self, spark: SparkSession, path: Path, schema: T.StructType) -> DataFrame:
        # the files as they are now: a snapshot, whatever is appended while the query runs
        if not any(path.rglob("*.parquet")):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", str(path)).parquet(str(path))

    def puts(self, spark: SparkSession, spec: TableSpec, hidden: bool = False) -> DataFrame:
        schema = spec.stored if hidden else T.StructType([*spec.business.fields, *[f for f in spec.stored.fields if f.name in META]])
        return self._read(spark, self.generation / spec.name / "puts", schema)

    def physical(self, spark: SparkSession, name: str, hidden: bool = False) -> DataFrame:
        """All rows ever put, with their deletion; hidden: tokens and vectors too. Puts are partitioned by day, so a window prunes files."""
        spec = self.schema.table(name)
        tombs = self._read(spark, self.generation / spec.name / "tombs", _TOMBS)
        puts = self.puts(spark, spec, hidden)
        shown = [*spec.visible, *[f.name for f in spec.stored.fields if f.name.startswith(("_tok_", "_vec_"))]] if hidden else spec.visible
        if not (self.generation / spec.name / "tombs").exists():
            return puts.withColumns({"deleted_ds": F.lit(None).cast("string"), "deleted_at": F.lit(None).cast("string")}).select(*shown)
        first = tombs.groupBy("_deleted").agg(F.min(F.struct("deleted_ds", "deleted_at")).alias("d"))
        joined = puts.join(first, puts[spec.primary].cast("string") == first["_deleted"], "left")
        return joined.withColumns({"deleted_ds": F.col("d.deleted_ds"), "deleted_at": F.col("d.deleted_at")}).select(*shown)

    def visible(self, spark: SparkSession, name: str, ds_start: str | None = None, ds_end: str | None = None) -> DataFrame:
        return self.physical(spark, name).where(window(ds_start, ds_end)).select(*self.schema.table(name).visible)

    # writes

    def _append(self, spec: TableSpec, day: str, records: list[dict]) -> None:
        path = self.files / f"ds={day}" / f"{spec.name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = "".join(json.dumps(r, ensure_ascii=False, default=_plain) + "\n" for r in records)
        torn = False
        if path.exists() and path.stat().st_size:
            with path.open("rb") as f:
                f.seek(-1, os.SEEK_END)
                torn = f.read(1) != b"\n"
        with path.open("a", encoding="utf-8") as f:
            f.write(("\n" if torn else "") + lines)
            f.flush()
            os.fsync(f.fileno())

    def check(self, spec: TableSpec, rows: list[dict], skip_existing: bool = False) -> list[dict]:
        """Rows with all columns, the first of each key if known keys are skipped. QueryError refuses the whole batch."""
        names = [c.name for c in spec.columns]
        out: dict[str, dict] = {}
        for r in rows:
            key = _key(spec, names, r)
            if str(key) in out and not skip_existing:
                raise QueryError(f"{spec.name}: {spec.primary} {key!r} comes twice")
            out.setdefault(str(key), {n: r.get(n) for n in names})
        if out:
            known = self.puts(self.spark, spec).select(F.col(spec.primary).alias("p"), F.col(spec.primary).cast("string").alias("k"))
            if len(out) <= EACH_KEY:  # each key's equality goes down to the files, whose filters of keys pass over nearly all that don't have it
                known = known.where(functools.reduce(operator.or_, [F.col("p") == F.lit(r[spec.primary]) for r in out.values()]))
            else:
                known = known.join(self.spark.createDataFrame([(k,) for k in out], "k string"), "k", "left_semi")
            known = known.select("k")
            taken = {r.k for r in known.collect()}  # at most as many as the batch
            if taken and not skip_existing:
                raise QueryError(f"{spec.name}: {spec.primary} {sorted(taken)[0]!r} is there already")
            out = {k: r for k, r in out.items() if k not in taken}
        return list(out.values())

    def insert(self, name: str, rows: list[dict], skip_existing: bool = False) -> int:
        """First the log, then the derived table."""
        spec = self.schema.table(name)
        rows = self.check(spec, rows, skip_existing)
        if not rows:
            return 0
        day, at = now()
        records = [{**r, "ds": day, "created_at": at} for r in rows]
        try:
            lines = [json.dumps(r, ensure_ascii=False, default=_plain) for r in records]
        except TypeError as e:
            raise QueryError(f"{name}: {e}") from e
        parsed = self._parsed(self.spark.createDataFrame([(x,) for x in lines], "value string"), spec)
        wrong = parsed.where("_corrupt IS NOT NULL").limit(1).collect()
        if wrong:
            raise QueryError(f"{name}: a value doesn't fit its column: {wrong[0]['_corrupt'][:200]}")
        self._append(spec, day, records)
        self._put(parsed.drop("_corrupt"), spec, self.generation, lines=len(lines))
        return len(rows)

    def _parsed(self, lines: DataFrame, spec: TableSpec) -> DataFrame:
        schema = T.StructType([*spec.business.fields, T.StructField("ds", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("_corrupt", T.StringType())])
        return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")

    def _put(self, rows: DataFrame, spec: TableSpec, generation: Path, lines: int | None = None) -> None:
        """Puts, by day; then for each searchable column its postings, by term, and how many rows and tokens they are of."""
        indexed = self.embedding.index(rows, spec.searchable) if spec.searchable else rows
        folder = generation / spec.name
        if lines is not None:
            indexed = indexed.coalesce(max(1, lines // 100_000))
        batch = uuid.uuid4().hex if spec.searchable else "all"  # its own postings are made from what has landed, not from a second embedding
        wide = indexed.select(*[f.name for f in spec.stored.fields], F.lit(batch).alias("_batch"))
        wide.write.mode("append").options(**filtered(spec.primary)).partitionBy("ds", "_batch").parquet(str(folder / "puts"))
        landed = self._read(self.spark, folder / "puts", T.StructType([*spec.stored.fields, T.StructField("_batch", T.StringType())])).where(F.col("_batch") == batch) if spec.searchable else wide
        for c in spec.searchable:
            tok = F.col(f"_tok_{c}")
            made = landed.where(tok.isNotNull()).select("ds", F.col(spec.primary).alias("key"), tok.alias("tok"), F.size(tok).alias("dl"))
            terms = term_lists(made)
            # a term's postings lie in one file of a batch, together: a search reads the few files and row groups that its words are in
            terms = terms.coalesce(1) if lines is not None and lines < 10_000 else terms.repartition("term")
            terms.sortWithinPartitions("term").write.mode("append").options(**filtered("term")).parquet(str(folder / f"post_{c}_lists"))
            made.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).coalesce(1).write.mode("append").parquet(str(folder / f"stat_{c}"))

    def postings(self, spark: SparkSession, name: str, col: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """(postings (term, key, tf, dl, ds), their counts (n, total), tombstones) of a searchable column; None if the generation was derived without."""
        spec = self.schema.table(name)
        folder = self.generation / name
        if not (folder / f"post_{col}_lists").exists():
            return None
        post = listed(spec.stored[spec.primary].dataType)
        stat = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])
        return unlisted(self._read(spark, folder / f"post_{col}_lists", post)), self._read(spark, folder / f"stat_{col}", stat), self._read(spark, folder / "tombs", _TOMBS)

    def insert_frame(self, name: str, rows: DataFrame, skip_existing: bool = False) -> int:
        """A distributed insert. The same rules: keys are checked by joins, the log is written by the executors, then the derived table from the log."""
        spec = self.schema.table(name)
        names = [c.name for c in spec.columns]
        if set(rows.columns) - set(names):
            raise QueryError(f"{name}: unknown columns {sorted(set(rows.columns) - set(names))}")
        staged = self.derived / f".staged-{uuid.uuid4().hex}"  # the frame is evaluated once: what is checked is what lands
        try:
            rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast(spec.business[n].dataType).alias(n) for n in names]).write.parquet(str(staged))
            return self._insert_staged(spec, self.spark.read.parquet(str(staged)), skip_existing)
        finally:
            shutil.rmtree(staged, True)

    def _insert_staged(self, spec: TableSpec, full: DataFrame, skip_existing: bool) -> int:
        name, key = spec.name, F.col(spec.primary).cast("string")
        if not full.where(key.isNull()).isEmpty():
            raise QueryError(f"{name}: a row has no {spec.primary}")
        known = self.puts(self.spark, spec).select(key.alias("__known"))
        if skip_existing:
            order = F.row_number().over(Window.partitionBy(key).orderBy("__at"))
            full = full.withColumn("__at", F.monotonically_increasing_id()).withColumn("__n", order).where("__n = 1").drop("__n", "__at")
            full = full.join(known, key == F.col("__known"), "left_anti")
        else:
            twice = full.groupBy(key.alias("k")).count().where("count > 1").limit(1).collect()
            taken = full.join(known, key == F.col("__known"), "left_semi").limit(1).collect()
            if twice or taken:
                raise QueryError(f"{name}: {spec.primary} {twice[0].k if twice else taken[0][spec.primary]!r} is there already or comes twice")
        day, at = now()
        values = [F.parse_json(c.name).alias(c.name) if c.type == "json" else F.col(c.name) for c in spec.columns]
        path = self._log_frame(spec, day, full.select(F.to_json(F.struct(*values, F.lit(day).alias("ds"), F.lit(at).alias("created_at")), {"ignoreNullFields": "false"}).alias("value")))
        lines = self.spark.read.text(str(path))
        self._put(self._parsed(lines, spec).drop("_corrupt"), spec, self.generation)
        return lines.count()

    def insert_lines(self, name: str, lines: DataFrame) -> int:
        """Rows of JSON lines (value, place), known keys left out, of keys that come again the first by place: what insert does with a few rows, done by the executors."""
        spec = self.schema.table(name)
        names, (day, at) = [c.name for c in spec.columns], now()

        def run(batches):
            for b in batches:
                rows = objects(b.column(0).to_pylist())
                keys = [str(_key(spec, names, r)) for r in rows]
                made = [json.dumps({**{n: r.get(n) for n in names}, "ds": day, "created_at": at}, ensure_ascii=False, default=_plain) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column(1), pa.array(made, pa.string())], ["key", "place", "value"])

        staged = self.derived / f".staged-{uuid.uuid4().hex}"  # processes run once
        part = None
        try:
            lines.mapInArrow(run, "key string, place long, value string").write.parquet(str(staged))
            before = F.lag(F.lit(1)).over(Window.partitionBy("key").orderBy("place"))
            first = self.spark.read.parquet(str(staged)).withColumn("before", before).where("before IS NULL").select("key", "value")
            new = first.join(self.puts(self.spark, spec).select(F.col(spec.primary).cast("string").alias("key")), "key", "left_anti").select("value")
            part = self._log_part(spec, day, new)
            n, wrong = self._parsed(self.spark.read.text(str(part)), spec).agg(F.count("*"), F.max("_corrupt")).first()
            if wrong is not None:
                raise QueryError(f"{name}: a value doesn't fit its column: {wrong[:200]}")
            if n:
                path, part = self._land(part), None
                self._put(self._parsed(self.spark.read.text(str(path)), spec).drop("_corrupt"), spec, self.generation)
            return n
        finally:
            shutil.rmtree(staged, True)
            if part:
                shutil.rmtree(part, True)

    def _log_frame(self, spec: TableSpec, day: str, lines: DataFrame) -> Path:
        """Executors write the lines as a part of the day's log, which is seen when all of it is there."""
        return self._land(self._log_part(spec, day, lines))

    def _log_part(self, spec: TableSpec, day: str, lines: DataFrame) -> Path:
        part = self.files / f"ds={day}" / f".{spec.name}.jsonl-{uuid.uuid4().hex}"
        lines.write.text(str(part))
        return part

    @staticmethod
    def _land(part: Path) -> Path:
        path = part.parent / part.name[1:]
        os.replace(part, path)
        return path

    def delete(self, name: str, where: Column | None, matched: DataFrame | None = None) -> int:
        """Mark live rows as deleted; their number. A few keys are logged by the driver, more by the executors."""
        spec = self.schema.table(name)
        day, at = now()
        live = matched if matched is not None else self.visible(self.spark, name).where(where)
        target = live.select(F.col(spec.primary).cast("string").alias("_deleted")).distinct()
        few = [r["_deleted"] for r in target.limit(DRIVER_KEYS + 1).collect()]
        if not few:
            return 0
        if len(few) <= DRIVER_KEYS:
            self._append(spec, day, [{"_deleted": k, "deleted_at": at} for k in few])
            tombs = self.spark.createDataFrame([(k, at, day) for k in few], _TOMBS).coalesce(1)
        else:
            path = self._log_frame(spec, day, target.select(F.to_json(F.struct("_deleted", F.lit(at).alias("deleted_at"))).alias("value")))
            tombs = self.spark.read.schema("_deleted string, deleted_at string").json(str(path)).withColumn("deleted_ds", F.lit(day))
        tombs.write.mode("append").partitionBy("deleted_ds").parquet(str(self.generation / name / "tombs"))
        return len(few) if len(few) <= DRIVER_KEYS else tombs.count()

    def log(self, spec: TableSpec) -> DataFrame:
        """(value, day) of a table's log lines, blank and torn ones too."""
        paths = [str(p) for p in sorted(self.files.glob(f"ds=*/{spec.name}.jsonl*"))]
        if not paths:
            return self.spark.createDataFrame([], "value string, day string")
        return self.spark.read.text(paths).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"ds=(\d{8})", 1).alias("day"))

    def rebuild(self) -> dict:
        """Derive everything anew from the log, beside what is in use, then switch. Of puts that repeat a key the earliest stays."""
        new = self.derived / f"gen-{uuid.uuid4().hex[:12]}"
        stats = {"tables": 0, "rows": 0, "tombstones": 0}
        for spec in self.schema.tables:
            lines = self.log(spec)
            stats["tables"] += 1
            whole = F.json_object_keys("value").isNotNull()  # blank and torn lines are passed over
            # a tombstone names _deleted, with or without escapes: lines without are not parsed to find that out
            is_tomb = (F.contains(F.col("value"), F.lit("_deleted")) | F.contains(F.col("value"), F.lit("\\u"))) & F.get_json_object("value", "$._deleted").isNotNull()
            tombs = lines.where(is_tomb & whole).select(F.get_json_object("value", "$._deleted").alias("_deleted"), F.get_json_object("value", "$.deleted_at").alias("deleted_at"), F.col("day").alias("deleted_ds"))
            puts = self._parsed(lines.where(F.col("value").rlike(r"^\s*\{") & ~is_tomb), spec).where(F.col(spec.primary).isNotNull() & F.col("_corrupt").isNull()).drop("_corrupt")
            # the first of a key has none before it; a row number would have Spark sort all rows before they are shuffled, too
            before = F.lag(F.lit(1)).over(Window.partitionBy(F.col(spec.primary).cast("string")).orderBy("ds", "created_at"))
            puts = puts.withColumn("__before", before).where("__before IS NULL").drop("__before")
            # a task has few days, and writes few files: one for each day in each task would be as many as their product
            tasks, days = int(self.spark.conf.get("spark.sql.shuffle.partitions")), len(list(self.files.glob("ds=*"))) or 1
            puts = puts.repartition("ds", F.pmod(F.xxhash64(spec.primary), F.lit(4 * -(-tasks // days))))
            self._put(puts, spec, new)
            tombs.write.mode("append").partitionBy("deleted_ds").parquet(str(new / spec.name / "tombs"))
            stats["rows"] += self._read(self.spark, new / spec.name / "puts", spec.stored).count()
            stats["tombstones"] += self._read(self.spark, new / spec.name / "tombs", _TOMBS).count()
        self._retire(new)
        return stats

    def _retire(self, new: Path) -> None:
        old = self.generation
        self._switch(new.name)
        self.retired = getattr(self, "retired", []) + [old]  # queries that run may still read it

    def compact(self) -> dict:
        """The same derived tables in fewer files, beside what is in use, then switch: many small inserts leave many small files. Nothing is parsed or embedded again."""
        new, stats = self.derived / f"gen-{uuid.uuid4().hex[:12]}", {"files_before": 0, "files_after": 0}
        for spec in self.schema.tables:
            for folder in sorted((self.generation / spec.name).glob("*")):
                size = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
                rows, to, n = self.spark.read.parquet(str(folder)), str(new / spec.name / folder.name), max(1, size >> 27)
                if folder.name == "puts":
                    parts = {d.name[3:]: sum(f.stat().st_size for f in d.rglob("*.parquet")) >> 27 for d in folder.glob("ds=*")}
                    share = F.coalesce(*[F.when(F.col("ds") == d, F.pmod(F.xxhash64(spec.primary), F.lit(k))) for d, k in parts.items() if k > 1], F.lit(0).cast("long"))  # a large day is of several tasks
                    rows.withColumn("_batch", F.lit("compact")).repartition(n, "ds", share).write.options(**filtered(spec.primary)).partitionBy("ds", "_batch").parquet(to)
                elif folder.name.startswith("post_"):
                    rows.repartition(max(1, size >> 25), "term").sortWithinPartitions("term").write.options(**filtered("term")).parquet(to)
                elif folder.name == "tombs":
                    rows.repartition(n).write.partitionBy("deleted_ds").parquet(to)
                else:
                    rows.coalesce(1).write.parquet(to)
                stats["files_before"] += sum(1 for _ in folder.rglob("*.parquet"))
                stats["files_after"] += sum(1 for _ in Path(to).rglob("*.parquet"))
        if stats["files_before"]:
            self._retire(new)
        return stats

    def sweep(self) -> None:
        """Remove generations that aren't in use; when no query runs."""
        for d in self.derived.iterdir():
            if d.is_dir() and d != self.generation:
                shutil.rmtree(d, True)


_TOMBS = T.StructType([T.StructField("_deleted", T.StringType()), T.StructField("deleted_at", T.StringType()), T.StructField("deleted_ds", T.StringType())])
