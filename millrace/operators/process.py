"""Rows through external processes: one chain for the whole input, JSON lines in and out."""

from __future__ import annotations

import os
import signal
import subprocess
import tempfile
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from ..errors import QueryError
from ..sources.shared import scratch

_FAILED = "MILLRACE-PROCESS: "


def run_chain(argvs: list[list[str]], feed: Iterator[bytes], timeout_s: float) -> Iterator[list[str]]:
    """Lines that come out of the last process, some thousand at a time. Its own process group and scratch folder; all are killed at the timeout."""
    env = {"PATH": os.environ.get("PATH", "/usr/bin:/bin"), "LC_ALL": "C.UTF-8"}
    with tempfile.TemporaryDirectory(prefix="millrace-run-") as cwd, tempfile.TemporaryFile() as errors:
        procs: list[subprocess.Popen] = []
        try:
            for argv in argvs:
                procs.append(subprocess.Popen(argv, cwd=cwd, env=env, stdin=procs[-1].stdout if procs else subprocess.PIPE, stdout=subprocess.PIPE, stderr=errors, start_new_session=True))
                if len(procs) > 1:
                    procs[-2].stdout.close()
        except OSError as e:
            _kill(procs)
            raise RuntimeError(f"{_FAILED}{argvs[len(procs)][0]}: {e.strerror}") from e
        late = threading.Event()
        timer = threading.Timer(timeout_s, lambda: (late.set(), _kill(procs)))
        timer.start()

        def write():
            try:
                for part in feed:
                    procs[0].stdin.write(part)
                procs[0].stdin.close()
            except (BrokenPipeError, ValueError, OSError):
                pass  # a process may stop reading early, as head does

        writer = threading.Thread(target=write, daemon=True)
        writer.start()
        try:
            held: list[str] = []
            for line in procs[-1].stdout:
                text = line.decode("utf-8", "replace").rstrip("\n")
                if text.strip():
                    held.append(text)
                if len(held) >= 5000:
                    yield held
                    held = []
            code = procs[-1].wait()
            if late.is_set():
                raise RuntimeError(f"{_FAILED}stopped after {timeout_s:g} s")
            if code:
                errors.seek(0)
                raise RuntimeError(f"{_FAILED}{argvs[-1][0]} ended with {code}: {errors.read(400).decode('utf-8', 'replace')}")
            if held:
                yield held
        finally:
            timer.cancel()
            _kill(procs)
            writer.join(1)


def _kill(procs: list[subprocess.Popen]) -> None:
    for p in procs:
        try:
            os.killpg(p.pid, signal.SIGKILL)
        except (ProcessLookupError, PermissionError):
            pass
        p.poll()


def _chain(argvs: list[list[str]], timeout_s: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed = (("\n".join(b.column(0).to_pylist()) + "\n").encode() for b in batches if b.num_rows)
        for lines in run_chain(argvs, feed, timeout_s):
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    return run


def through(df: DataFrame, argvs: list[list[str]], timeout_s: float = 30.0, by_row: bool = False) -> DataFrame:
    """Rows that the processes make of df's rows.

    One chain sees the whole input, in one task: that is what `head -1` or `sort` in a pipeline means. The input should be what earlier stages left over.
    With by_row each partition has a chain of its own.
    Its result is written to the shared folder, so it runs once however often it is read. Columns are in order of first appearance; their types are inferred.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    lines = df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    lines = (lines if by_row else lines.coalesce(1)).mapInArrow(_chain(argvs, timeout_s), "value string")
    path = scratch(df.sparkSession)
    try:
        lines.write.text(path)
    except PySparkException as e:
        _raise(e)
    return read_lines(df.sparkSession, path)


def _raise(e: Exception) -> None:
    text = str(e)
    if _FAILED in text:
        raise QueryError(text.split(_FAILED, 1)[1].split("\n")[0]) from e
    raise e


def read_lines(spark, path: str) -> DataFrame:
    """Objects of a folder of JSON lines; QueryError for a line that isn't one."""
    lines = spark.read.text(path)
    keys = F.json_object_keys("value")
    wrong = lines.where(keys.isNull()).limit(1).collect()
    if wrong:
        raise QueryError(f"not a JSON object: {wrong[0].value[:200]!r}")
    seen = lines.select(F.monotonically_increasing_id().alias("row"), F.posexplode(keys).alias("at", "key")).groupBy("key").agg(F.min(F.struct("row", "at")).alias("first"))
    names = [r.key for r in seen.orderBy("first").collect()]
    if not names:
        return spark.createDataFrame([], "_empty string")
    return spark.read.json(path).select(*[F.col(f"`{n}`") for n in names])
