"""Hashes of many places packed into blobs by shard: a few bytes a place, not a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import worker

SCHEMA = "shard int, blob binary"
_32 = np.uint64(32)


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """The shard by the top 24 bits."""
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers, all lowest ones first: what rarely changes lies together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack(columns: list[np.ndarray]) -> bytes:
    """Integers of 32 or 64 bits, compressed; for each column its differences, if they are nearer to zero; of a column of one value that value and its length."""
    out = [np.array([len(columns)], np.uint32).tobytes()]
    for x in columns:
        signed = x.dtype.kind == "i"
        if signed and len(x) and (x == x[0]).all():
            raw, code = np.array([len(x), x[0]], np.int64).tobytes(), 1 << 9
        else:
            step = np.diff(x, prepend=x.dtype.type(0))
            code, best = min(((0, x), (1, step)), key=lambda c: int(np.abs(c[1].astype(np.float64)).sum())) if signed else (0, x)
            raw = _planes(best)
            raw = zstandard.compress(raw, 1) if signed else raw  # hashes don't compress
        out.append(np.array([code | x.itemsize << 1 | signed << 8, len(raw)], np.uint32).tobytes() + raw)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.uint32, 1)[0]), 4, []
    for _ in range(n):
        code, size = map(int, np.frombuffer(blob, np.uint32, 2, at))
        raw, at = blob[at + 8 : at + 8 + size], at + 8 + size
        signed, kind = code >> 8 & 1, ("i" if code >> 8 & 1 else "u") + str(code >> 1 & 127)
        if code >> 9 & 1:
            length, value = np.frombuffer(raw, np.int64).tolist()
            out.append(np.full(length, value, kind))
            continue
        x = _unplanes(zstandard.decompress(raw) if signed else raw, kind)
        out.append(np.cumsum(x, dtype=x.dtype) if code & 1 else x)
    return out


def by_shard(shard: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row (shard, blob) for each shard; places keep their order in it."""
    if not len(shard):
        return
    order = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 else shard, kind="stable")
    ids, start = np.unique(shard[order], return_index=True)
    ends = [*start[1:].tolist(), len(order)]
    sorted_ = [c[order] for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array([pack([c[i:j] for c in sorted_]) for i, j in zip(start.tolist(), ends)], pa.binary())], ["shard", "blob"])


def place_blobs(h: np.ndarray, keep: type, n: int, *place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blobs of (hash bits below the shard's, each column of the place); places are in the order of documents."""
    yield from by_shard(shard_of(h, n), [h.astype(keep), *place])


def per_shard(df: DataFrame, n: int, work: Callable[[int, list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Give work each shard's number and its joined columns; a partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        shard = None
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1)):
                shard = s
                parts.append(unpack(blob.as_buffer().to_pybytes()))
        if parts:
            yield from work(shard, [np.concatenate(c) for c in zip(*parts)])

    return df.repartitionById(n, df["shard"]).transform(worker, run, schema)


def groups(h: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by h, then by the others; which begin a group of equal h; each one's group."""
    order = np.lexsort((*reversed(then), h)) if then else np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    return order, new, np.cumsum(new) - 1
