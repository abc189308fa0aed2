"""Helpers shared by the operators: shared-folder tables, word arrays, row keys."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text that a Python worker handles at a time; a single longer text is one chunk of its own.
CHUNK_BYTES = 4 << 20
#: The most bytes of a table that is broadcast, and the rows of a key from which it is handled as a hot one. Both choose a plan, never rows.
BROADCAST_BYTES, HOT_ROWS = 16 << 20, 200_000

_written: set[str] = set()


@lru_cache(1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own_dir()
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at exit; the folder is the cluster's to clean then
            _written.discard(path)


def until_exit(spark: SparkSession, path: str) -> str:
    """A folder of the shared one that is removed when this process ends, if not before."""
    if not _written:
        atexit.register(_remove_all)
    _written.add(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing lazy may still read."""
    _remove(spark, path)


class Table:
    """A table written to the shared folder: it cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, *by: str):
        self.spark = df.sparkSession
        self.path = until_exit(self.spark, f"{shared_dir(self.spark)}/millrace-{uuid.uuid4().hex}")
        self.schema = df.schema
        df.write.option("compression", "zstd").partitionBy(*by).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; nothing lazy may still read them."""
        _remove(self.spark, self.path)


def written(df: DataFrame) -> DataFrame:
    return Table(df).read()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def worker(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow; at a task's end its Python process, which waits for the next task, gives back what it no longer needs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(task, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards(spark: SparkSession, size: int, per_shard: int) -> int:
    """Shards of about per_shard, for a measured size; at least the shuffle partitions, which are all that a small input gets."""
    return max(shuffle_partitions(spark), min(100_000, -(-size // per_shard)))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def doc_id(df: DataFrame, name: str) -> Column:
    """The id as a long. TypeError unless it is of a whole-number type: a string cast to one would fail in the middle of the job, or lose what it says."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} is {kind.simpleString()}; ids are whole numbers")
    return F.col(name).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed until df has no column that is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_hash(text: str = "text"):
    """With the id, the key of a document: rows that repeat both are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def weight(df: DataFrame) -> int:
    """Bytes that df's rows take in memory, about."""
    def of(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.lit(16) + F.coalesce(F.octet_length(name), F.lit(0))
        if isinstance(kind, T.ArrayType):
            each = 16 + 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
            return F.lit(24) + F.greatest(F.size(name), F.lit(0)) * each
        return F.lit(8)

    row = F.lit(32)
    for f in df.schema.fields:
        row += of(f.name, f.dataType)
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def join_small(big: DataFrame, other: DataFrame, on, how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Join a wide table with a written narrow one: broadcast if it was measured to be of at most so many bytes, else by a hash join that doesn't sort the wide side."""
    return big.join(F.broadcast(other) if weight(other) <= most else other.hint("shuffle_hash"), on, how)


def join_hot(big: DataFrame, keyed: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join of two written tables; keyed has a row for each key, and in its column rows how many of big's have it.

    Keys with more than HOT_ROWS rows, of which there are at most big's rows / HOT_ROWS, are broadcast, so that none of them makes a task of its own; the others' rows are shuffled.
    """
    hot = keyed.where(F.col(rows) > HOT_ROWS)
    if hot.isEmpty():
        return big.join(keyed, keys)
    return big.join(keyed.where(F.col(rows) <= HOT_ROWS), keys).unionByName(big.join(F.broadcast(hot), keys))


def as_text(column: pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of text each."""
    for b in batches:
        if not b.num_rows:
            continue
        end = np.cumsum(pc.binary_length(as_text(b.column(text))).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            stop = int(np.searchsorted(end, (end[start - 1] if start else 0) + limit, side="right"))
            stop = max(stop, start + 1)
            yield b.slice(start, stop - start)
            start = stop


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words in order, the distinct words, and where each text's words begin and end. Words are what ASCII white space separates."""
    texts = as_text(texts)
    if lower:
        texts = pc.utf8_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    at = np.concatenate([[0], np.cumsum(full)])
    offsets = at[split.offsets.to_numpy() - split.offsets[0].as_py()]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), offsets.astype(np.int64)


def hash64(strings: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(s) for s in strings), np.uint64, len(strings))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.repeat(starts.astype(np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return first + np.arange(total)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
