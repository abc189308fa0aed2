"""Substring dedup: passages that occur before, found from anchors at fixed blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blobs import SCHEMA, by_shard, groups, per_shard, place_blobs
from .common import doc_id, fresh, hash64, mix, pieces, shards, text_bytes, text_hash, words, worker, written

MIN_WORDS = 50
_BASE = 0x9E3779B97F4A7C15
SHARD_BYTES = 16 << 20  # bytes of text whose windows a shard holds, about
_CHUNK = 2 << 20  # bytes of text whose windows are made at once
_HELD = 500_000  # windows that a task holds before it packs them


class Rolling:
    """Hashes of all windows of consecutive words, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        if len(self.up) <= len(h):
            n = max(len(h) + 1, 1 << 20)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)])])
        return mix((total[starts + size] - total[starts]) * self.down[starts])


def _windows(batches: Iterator[pa.RecordBatch], size: int, of=None) -> Iterator[tuple[np.ndarray, ...]]:
    """(hashes, document ids, tags, positions) of the windows of size words; of: chosen starts of a batch's rows."""
    roll = Rolling()
    for b in pieces(batches, limit=_CHUNK):
        codes, distinct, off = words(b.column(1))
        h = hash64(distinct)[codes] if distinct else np.empty(0, np.uint64)
        n = np.diff(off)
        count = np.maximum(n - size + 1, 0)
        row = np.repeat(np.arange(b.num_rows), count)
        pos = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        start = pos + np.repeat(off[:-1], count)
        if of is not None:
            chosen = of(b, count)
            row, pos, start = row[chosen], pos[chosen], start[chosen]
        doc, tag = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
        yield roll(h, start, size), doc[row], tag[row], pos


def _packed(windows, keep: type, n: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for w in windows:
        held.append(w)
        size += len(w[0])
        if size > _HELD:
            yield from place_blobs(*_joined(held, keep, n))
            held, size = [], 0
    if held:
        yield from place_blobs(*_joined(held, keep, n))


def _joined(held, keep, n):
    h, *place = (np.concatenate(c) for c in zip(*held))
    return h, keep, n, *place


def _hits(block: int):
    def work(_, columns) -> Iterator[pa.RecordBatch]:
        h, doc, tag, pos = columns
        order, new, group = groups(h)
        size = np.bincount(group)
        indexed = np.bincount(group, weights=pos[order] % block == 0) > 0
        hit = order[(size[group] > 1) & indexed[group]]
        for i in range(0, len(hit), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[hit[i : i + 200_000]]) for x in (doc, tag, pos)], ["doc", "tag", "pos"])

    return work


def _candidates(size: int, block: int):
    """Starts of the windows of size words that hold a hit."""

    def of(b: pa.RecordBatch, count: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(count)])
        change = np.zeros(at[-1] + 1, np.int32)
        hits = b.column(3)
        flat = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), np.diff(hits.offsets.to_numpy()))
        flat, row = flat[count[row] > 0], row[count[row] > 0]
        np.add.at(change, at[row] + np.clip(flat - (size - block), 0, count[row]), 1)
        np.add.at(change, at[row] + np.minimum(flat + 1, count[row]), -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    return of


def _repeats(n: int):
    def work(_, columns) -> Iterator[pa.RecordBatch]:
        h, doc, tag, pos = columns
        order, new, group = groups(h, doc, tag, pos)
        doc, tag, pos = doc[order], tag[order], pos[order]
        first = np.flatnonzero(new)[group]
        later = (doc != doc[first]) | (tag != tag[first]) | (pos != pos[first])
        d, t, p, fd, ft, fp = doc[later], tag[later], pos[later], doc[first][later], tag[first][later], pos[first][later]
        o = np.lexsort((p, ft, fd, t, d))
        d, t, p, fd, ft, fp = (x[o] for x in (d, t, p, fd, ft, fp))
        to = ((mix((d ^ t).astype(np.uint64)) >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)
        yield from by_shard(to, [d, t, p, fd, ft, p - fp])

    return work


def _spans(size: int):
    def work(_, columns) -> Iterator[pa.RecordBatch]:
        d, t, p, fd, ft, diagonal = columns
        o = np.lexsort((p, diagonal, ft, fd, t, d))
        d, t, p, fd, ft, diagonal = (x[o] for x in (d, t, p, fd, ft, diagonal))
        new = np.ones(len(d), bool)
        # rows that repeat give a window twice: a step of 0 goes on as one of 1 does
        new[1:] = (p[1:] - p[:-1] > 1)
        for x in (d, t, fd, ft, diagonal):
            new[1:] |= x[1:] != x[:-1]
        start = np.flatnonzero(new)
        end = np.concatenate([start[1:], [len(d)]]) - 1
        for i in range(0, len(start), 100_000):
            s, e = start[i : i + 100_000], end[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[s]), pa.array(t[s]), pa.array(p[s]), pa.array(p[e] - p[s] + np.int32(size)), pa.array(fd[s]), pa.array(ft[s]), pa.array(p[s] - diagonal[s])],
                ["doc_id", "th", "start_word", "n_words", "first_doc_id", "first_th", "first_start_word"],
            )

    return work


def _tag(docs: DataFrame, id_col: str, text_col: str):
    """What tells texts with the same id apart: nothing (0) if all ids have one text each, else the text's hash."""
    th = docs.select(doc_id(docs, id_col).alias("doc"), text_hash(text_col).alias("th")).where("doc IS NOT NULL")
    several = not th.groupBy("doc").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").isEmpty()
    return text_hash(text_col) if several else F.lit(0).cast("long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row (doc_id, th, start_word, n_words, first_doc_id, first_th, first_start_word) for each maximal exact repeat of at least min_words words.

    A passage repeats what occurs in an earlier document, by id and then hash of the text, or earlier in its own. Words are what ASCII white space
    separates, compared exactly. Each window of min_words words is referred to its first occurrence; windows in a row
    that keep the distance to the same document are one repeat, extended as far as that holds. A repeat may overlap its first occurrence (text
    that cycles): less its repeats, one cycle of it stays.

    Every document's non-overlapping blocks of (min_words + 1) // 2 words are the index. Any passage of min_words words has a whole
    block in it, so probing the index with every rolling window of that many words misses none: windows are sent to the index's
    shard (4 bytes of hash and about 2 of place each), and both sides of a match are hits. Around hits every window of min_words words
    is hashed with 64 bits besides the shard's, and grouped. All window hashes, over whole texts, take part; there is no cap.

    Rows with a null id are not searched, null texts have no words. Rows that repeat an id and its text are one document and repeat nothing; an id
    with several texts is several documents, and th and first_th, else 0, are their hashes. Ids of another than a whole-number type are a TypeError. An
    empty table gives no rows; other columns are not read.
    """
    block = (min_words + 1) // 2
    d = docs.select(doc_id(docs, id_col).alias("doc"), F.col(text_col).alias("text"), _tag(docs, id_col, text_col).alias("tag")).where("doc IS NOT NULL AND text IS NOT NULL")
    n = shards(docs.sparkSession, text_bytes(d), SHARD_BYTES)
    probes = d.transform(worker, lambda batches: _packed(_windows(batches, block), np.uint32, n), SCHEMA)
    hits = per_shard(probes, n, _hits(block), "doc long, tag long, pos int").groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(F.collect_list("pos").alias("__hits"))
    # hits grow with the table, so they are broadcast at no size
    near = d.join(written(hits).hint("shuffle_hash"), (F.col("doc") == F.col("__doc")) & (F.col("tag") == F.col("__tag"))).select("doc", "text", "tag", "__hits")
    found = near.transform(worker, lambda batches: _packed(_windows(batches, min_words, _candidates(min_words, block)), np.uint64, n), SCHEMA)
    later = per_shard(found, n, _repeats(n), SCHEMA)
    return per_shard(later, n, _spans(min_words), "doc_id long, th long, start_word int, n_words int, first_doc_id long, first_th long, first_start_word int")


_WORD = re.compile(r"[^ \t\n\v\f\r]+")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans (first word, how many) and the white space before each."""
    where = [m.span() for m in _WORD.finditer(text)]
    gone = np.zeros(len(where) + 1, bool)
    for a, n in spans:
        gone[a : a + n] = True
    out, at = [], 0
    edge = np.flatnonzero(np.diff(gone, prepend=False))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(text[at : where[a - 1][1] if a else 0])
        at = where[b - 1][1]
    out.append(text[at:])
    return "".join(out)


def _cutter(text: str, spans: str):
    def cut(batches):
        for b in batches:
            gone = b.column(spans).to_pylist()
            new = [t if s is None or t is None else cut_spans(t, [(x["start_word"], x["n_words"]) for x in s]) for t, s in zip(b.column(text).to_pylist(), gone)]
            yield b.set_column(b.schema.get_field_index(text), b.schema.field(text), pa.array(new, b.schema.field(text).type)).drop_columns([spans])

    return cut


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, without the words that repeated_spans lists; documents of which nothing is left go (null texts with them). Columns of any name may be there."""
    doc, th, gone, key = fresh(docs, "__doc", "__th", "__spans", "__key")
    spans = repeated_spans(docs, id_col, text_col, min_words).groupBy(F.col("doc_id").alias(doc), F.col("th").alias(th)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(gone))
    keyed = docs.withColumn(key, _tag(docs, id_col, text_col))
    joined = keyed.join(written(spans).hint("shuffle_hash"), (F.col(id_col) == F.col(doc)) & (F.col(key) == F.col(th)), "left").drop(doc, th, key)
    return joined.transform(worker, _cutter(text_col, gone), docs.schema).where(F.length(F.regexp_replace(text_col, r"\s+", "")) > 0)


ORACLE = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != '') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(generate_series(0, len(w) - {MIN_WORDS})) AS pos FROM w WHERE len(w) >= {MIN_WORDS}
), k AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + {MIN_WORDS}], ' ')) AS k FROM s
), f AS (
  SELECT doc_id, pos, first_value(doc_id) OVER o AS first_doc_id, first_value(pos) OVER o AS first_pos FROM k WINDOW o AS (PARTITION BY k ORDER BY doc_id, pos)
), g AS (
  SELECT *, pos - first_pos AS diagonal, pos - row_number() OVER (PARTITION BY doc_id, first_doc_id, pos - first_pos ORDER BY pos) AS island
  FROM f WHERE doc_id != first_doc_id OR pos != first_pos
)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(count(*) + {MIN_WORDS - 1} AS INTEGER) AS n_words, first_doc_id, CAST(min(first_pos) AS INTEGER) AS first_start_word
FROM g GROUP BY doc_id, first_doc_id, diagonal, island
"""
