"""Line dedup: each line of the corpus stays where it first occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_text, doc_id, fresh, pieces, shuffle_partitions, text_hash, worker, written

_EDGE = " \t\r"
_LOCAL = 400_000  # lines that a task remembers for its own dedup before it starts afresh


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    first: dict[bytes, tuple] = {}

    def out():
        raw = np.frombuffer(b"".join(first), np.dtype(">i8")).reshape(-1, 2).astype(np.int64)
        doc, th, pos, n = zip(*first.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(raw[:, 0]), pa.array(raw[:, 1]), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32())],
            ["h1", "h2", "doc", "th", "pos", "n"],
        )

    for b in pieces(batches):
        for doc, text, th in zip(b.column(0).to_pylist(), as_text(b.column(1)).to_pylist(), b.column(2).to_pylist()):
            lines = text.split("\n")
            rank = (doc is not None, doc or 0, th)  # as Spark sorts: null ids first
            for pos, line in enumerate(lines):
                line = line.strip(_EDGE)
                if line:
                    key = digest(line)
                    old = first.get(key)
                    if old is None or (rank, pos) < ((old[0] is not None, old[0] or 0, old[1]), old[2]):
                        first[key] = (doc, th, pos, None)
                else:  # kept always: a key of its own
                    first[digest(f"\n{doc}\n{th}\n{pos}")] = (doc, th, pos, None)
            first[digest(f"\n{doc}\n{th}")] = (doc, th, -1, len(lines))
            if len(first) > _LOCAL:
                yield out()
                first.clear()
    if first:
        yield out()


def _first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        h = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        new = np.ones(b.num_rows, bool)
        new[1:] = (h[:, 1:] != h[:, :-1]).any(0)
        new[0] = last is None or (h[:, 0] != last).any()
        last = h[:, -1].copy()
        yield b.select(["doc", "th", "pos", "n"]).filter(pa.array(new))


def _runs(kept: list[int], n: int) -> str:
    """Lengths of the alternate runs of kept and dropped lines, a kept run first."""
    runs, at, keeping = [], 0, True
    bits = np.zeros(n, bool)
    bits[kept] = True
    change = np.flatnonzero(np.diff(bits)) + 1
    for stop in [*change.tolist(), n]:
        if keeping and not runs and not bits[0]:
            runs.append(0)
        runs.append(stop - at)
        at = stop
    return ",".join(map(str, runs))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [[p for p in ps if p >= 0] for ps in b.column(2).to_pylist()]
        n = b.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(3), pa.array([len(k) for k in kept], pa.int32()), pa.array([_runs(k, m) for k, m in zip(kept, n)], pa.string())],
            ["doc_id", "th", "n_lines", "n_kept", "keep_runs"],
        )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, th, n_lines, n_kept, keep_runs) for each document.

    A line is what newlines separate, without spaces, tabs and carriage returns at its ends. It stays only in the
    first document that has it, by (id, hash of the text, position), and there at its first position. keep_runs is
    the bitmap of kept lines, run-length coded: lengths of alternate kept and dropped runs, a kept run first (0 if the
    first line goes).

    Each task first drops the repeats that it sees itself, so a line is sent once a task however often it occurs. Its
    128-bit hash is range-partitioned (hashes are uniform, so the bounds need no sampling) and sorted with document
    and position behind it; a stream over the sorted rows keeps the first of each run. No text is shuffled.

    Blank lines always stay. A null text counts as empty: one blank line, kept. A null id sorts before all others.
    Rows that repeat an id and its text are one document. Ids of another than a whole-number type are a TypeError. Other columns are not read. An empty table gives none.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(doc_id(docs, id_col).alias("doc"), F.col(text_col).alias("text"), text_hash(text_col).alias("th")).transform(worker, 
        _line_rows, "h1 long, h2 long, doc long, th long, pos int, n int"
    )
    part = F.least(F.lit(n - 1), F.floor((F.col("h1") / F.lit(2.0**64) + 0.5) * n)).cast("int")
    first = rows.repartitionById(n, part).sortWithinPartitions("h1", "h2", "doc", "th", "pos").transform(worker, _first_of_run, "doc long, th long, pos int, n int")
    return first.groupBy("doc", "th").agg(F.collect_list("pos").alias("kept"), F.max("n").alias("n")).transform(worker, 
        _bitmaps, "doc_id long, th long, n_lines int, n_kept int, keep_runs string"
    )


def apply_runs(text: str, runs: str) -> str:
    lines, out, at = text.split("\n"), [], 0
    for k, n in enumerate(map(int, runs.split(","))):
        if k % 2 == 0:
            out += lines[at : at + n]
        at += n
    return "\n".join(out)


def _cut(text: str, column: str):
    def cut(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            runs = b.column(column).to_pylist()
            new = [t if r is None or t is None else apply_runs(t, r) for t, r in zip(b.column(text).to_pylist(), runs)]
            yield b.set_column(at, b.schema.field(text), pa.array(new, b.schema.field(text).type)).drop_columns([column])

    return cut


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the lines dropped that keep_bitmaps drops; documents left blank go (null texts with them). Columns of any name may be there."""
    doc, th, runs, key = fresh(docs, "__doc", "__th", "__runs", "__key")
    changed = written(keep_bitmaps(docs, id_col, text_col).where("n_kept < n_lines").select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("keep_runs").alias(runs)))
    joined = docs.withColumn(key, text_hash(text_col)).join(changed.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left").drop(doc, th, key)  # bitmaps grow with the table
    return joined.transform(worker, _cut(text_col, runs), docs.schema).where(F.length(F.regexp_replace(text_col, r"\s+", "")) > 0)


ORACLE = """
WITH l AS (
  SELECT doc_id, u.i - 1 AS pos, trim(string_split(coalesce(text, ''), chr(10))[u.i], ' ' || chr(9) || chr(13)) AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i) u
), f AS (
  SELECT doc_id, pos, line = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, pos) = 1 AS keep FROM l
), g AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, keep ORDER BY pos) AS island FROM f
), r AS (
  SELECT doc_id, keep, island, min(pos) AS pos, count(*) AS n FROM g GROUP BY ALL
)
SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE keep), 0) AS INTEGER) AS n_kept,
  CASE WHEN arg_min(keep, pos) THEN '' ELSE '0,' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY pos) AS keep_runs
FROM r GROUP BY doc_id
"""
