"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import doc_id, join_small, lists, pieces, words, worker, written

SHINGLE, K, GROUP_K = 5, 64, 1024
P = (1 << 61) - 1
#: Fixed odd multipliers of the shingle hash, below P.
MULTIPLIERS = [int.from_bytes(hashlib.md5(b"shingle %d" % i).digest()[:8], "big") % P | 1 for i in range(16)]
_M31, _M30, _P = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(P)


def word_hashes(distinct: list[str]) -> np.ndarray:
    """The first 60 bits of each word's MD5."""
    raw = b"".join([hashlib.md5(w.encode()).digest()[:8] for w in distinct])
    return np.frombuffer(raw, ">u8").astype(np.uint64) >> np.uint64(4)


def _mulmod(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo 2^61 - 1 without overflow, a below it."""
    au, ad = a >> np.uint64(31), a & _M31
    bu, bd = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    mid = ad * bu + au * bd
    x = au * bu * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & _M30) << np.uint64(31)) + ad * bd
    x = (x >> np.uint64(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def shingle_hashes(h: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and each text's offsets in them. A text of fewer words is one shingle of what it has; one of none has none."""
    size = np.diff(offsets)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    start = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    have = np.repeat(np.minimum(size, n), count)
    total = np.zeros(len(start), np.uint64)
    for i in range(n):
        part = _mulmod(h[np.minimum(start + i, max(len(h) - 1, 0))], MULTIPLIERS[i]) if len(h) else total
        total += np.where(i < have, part, np.uint64(0))
        total = np.where(total >= _P, total - _P, total)
    return total, np.concatenate([[0], np.cumsum(count)])


def bottom(x: np.ndarray, k: int) -> np.ndarray:
    """The k least distinct values, ascending."""
    if len(x) > 8 * k:  # the k least with repeats are often enough
        y = np.unique(np.partition(x, 4 * k)[: 4 * k])
        if len(y) >= k:
            return y[:k]
    return np.unique(x)[:k]


def _sketches(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            codes, distinct, offsets = words(b.column(1), lower=True)
            hashes, at = shingle_hashes(word_hashes(distinct)[codes] if distinct else np.empty(0, np.uint64), offsets, n)
            each = [bottom(hashes[i:j], k) for i, j in zip(at[:-1], at[1:])]
            flat = np.concatenate([*each, np.empty(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists(flat, np.concatenate([[0], np.cumsum([len(e) for e in each])]), pa.int64()), *[b.column(i) for i in range(2, b.num_columns)]],
                ["doc_id", "sketch", *b.schema.names[2:]],
            )

    return run


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """One row (doc_id, sketch[, grp]) for each row: the k least distinct hashes of its shingles of words, ascending.

    Words are lower-cased and separated by ASCII white space. Hashes are uniform below 2^61 - 1: a linear hash, modulo that prime, of the words' MD5 prefixes. A text of
    fewer words than a shingle is one shingle; a null text or one without words has an empty sketch. Repeated rows
    each give a row; ids may be null. No shuffle.
    """
    cols = [doc_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")] + ([F.col(group_col).cast("string").alias("grp")] if group_col else [])
    return docs.select(*cols).transform(worker, _sketches(shingle, k), "doc_id long, sketch array<long>" + (", grp string" if group_col else ""))


#: Groups that a task holds sketches of before it hands them on: what it needs doesn't grow with the groups.
_HELD_GROUPS = 2000


def _task_sketches(n: int, k: int):
    def out(best: dict[str, np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(list(best.values())).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), lists(flat, np.concatenate([[0], np.cumsum([len(x) for x in best.values()])]), pa.int64())], ["grp", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, np.ndarray] = {}
        for b in pieces(batches, text=0):
            codes, distinct, offsets = words(b.column(0), lower=True)
            hashes, at = shingle_hashes(word_hashes(distinct)[codes] if distinct else np.empty(0, np.uint64), offsets, n)
            group = b.column(1).dictionary_encode("encode")
            of = group.indices.to_numpy(zero_copy_only=False)
            each = np.repeat(of, np.diff(at))
            by = hashes[np.argsort(each, kind="stable")]
            end = np.cumsum(np.bincount(each, minlength=len(group.dictionary)))
            for name, i, j in zip(group.dictionary.to_pylist(), [0, *end.tolist()], end.tolist()):
                mine = bottom(by[i:j], k)
                best[name] = bottom(np.concatenate([best[name], mine]), k) if name in best else mine
            if len(best) > _HELD_GROUPS:
                yield out(best)
                best = {}
        if best:
            yield out(best)

    return run


def merge(sketches: DataFrame, group: str = "grp", k: int = K) -> DataFrame:
    """(group, sketch): the sketch of each group's union, in two levels, so that no task holds very many sketches. A null group is a group."""
    least = lambda df, *by: df.groupBy(*by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, k).alias("sketch"))
    return least(least(sketches.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(1000))), group, "part"), group)


def sketch_groups(docs: DataFrame, group_col: str, text_col: str = "text", shingle: int = SHINGLE, k: int = GROUP_K) -> DataFrame:
    """(grp, sketch) of all shingles of each group's texts. Each task merges what it reads, so k hashes a task and group are shuffled."""
    d = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("grp"))
    return merge(d.transform(worker, _task_sketches(shingle, k), "grp string, sketch array<long>"), k=k)


def estimate_distinct(s, k: int):
    """Distinct shingles that a sketch stands for: exact if it isn't full, else (k - 1) P / its largest hash."""
    full = F.size(s) >= k
    return F.when(full, (F.lit(float(k - 1)) * F.lit(float(P))) / F.element_at(s, -1).cast("double")).otherwise(F.size(s).cast("double"))


def compare(a, b, k: int, union_k: int | None = None) -> dict:
    """Columns estimating two sketched sets' resemblance |A∩B|/|A∪B| and containment |A∩B|/|A|, from the least hashes of their union.

    The union's sketch has as many hashes as both sketches can vouch for: those not above the last of a full one.
    Two empty sets resemble fully (1), an empty one is contained (1), in a set an empty one is not. sampled: how many hashes of A the
    containment rests on; if A has hashes and none of them counts, its containment is unknown, not 1.
    """
    top = lambda s, n: F.when(F.size(s) >= n, F.element_at(s, -1)).otherwise(F.lit(P))
    limit = F.least(top(a, k), top(b, union_k or k))
    ca, cb = F.filter(a, lambda x: x <= limit), F.filter(b, lambda x: x <= limit)
    both, either = F.size(F.array_intersect(ca, cb)).cast("double"), F.size(F.array_union(ca, cb)).cast("double")
    return {
        "resemblance": F.when(either > 0, both / either).otherwise(F.lit(1.0)),
        "containment": F.when(F.size(ca) > 0, both / F.size(ca)).otherwise(F.lit(1.0)),
        "sampled": F.size(ca),
    }


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source") -> DataFrame:
    """One row (doc_id, source, n_hashes, sketch, distinct, group_distinct, resemblance, containment) for each row of docs.

    Sketches with K hashes, and of each group (null and "" are one) the merged sketch of GROUP_K hashes: estimates of the
    document's and the group's distinct shingles, and of the document's resemblance to and containment in its group. sketch is comma-separated.
    """
    groups = sketch_groups(docs, group_col, text_col).withColumnRenamed("sketch", "everything")
    d = sketch(docs, id_col, text_col, group_col).withColumn("grp", F.coalesce("grp", F.lit(""))).withColumnRenamed("sketch", "least")
    d = join_small(d, written(groups), "grp", "inner")
    one, all_ = F.col("least"), F.col("everything")
    c = compare(one, all_, K, GROUP_K)
    return d.select(
        "doc_id", F.col("grp").alias("source"), F.size(one).alias("n_hashes"), F.array_join(one.cast("array<string>"), ",").alias("sketch"), F.round(estimate_distinct(one, K), 3).alias("distinct"),
        F.round(estimate_distinct(all_, GROUP_K), 3).alias("group_distinct"), F.round(c["resemblance"], 9).alias("resemblance"), F.round(c["containment"], 9).alias("containment"),
    )


def source_pairs(docs: DataFrame, text_col: str = "text", group_col: str = "source") -> DataFrame:
    """One row (source, other, distinct, other_distinct, n_sampled, resemblance, containment) for each ordered pair of distinct groups.

    Estimates from the groups' merged sketches of GROUP_K hashes: each one's distinct shingles, their resemblance, and how much of source is
    contained in other. n_sampled: the hashes of source that the containment rests on; it is null where source has shingles and none of their
    hashes is low enough. Null and "" are one group. Rows grow with the square of the groups, not with the documents.
    """
    groups = written(sketch_groups(docs, group_col, text_col))
    one, other = groups.select(F.col("grp").alias("source"), F.col("sketch").alias("a")), groups.select(F.col("grp").alias("other"), F.col("sketch").alias("b"))
    a, b = F.col("a"), F.col("b")
    c = compare(a, b, GROUP_K)
    return one.crossJoin(other).where("source != other").select(
        "source", "other", F.round(estimate_distinct(a, GROUP_K), 3).alias("distinct"), F.round(estimate_distinct(b, GROUP_K), 3).alias("other_distinct"), c["sampled"].alias("n_sampled"),
        F.round(c["resemblance"], 9).alias("resemblance"), F.when((F.size(a) == 0) | (c["sampled"] > 0), F.round(c["containment"], 9)).alias("containment"),
    )


_TERMS = " + ".join(f"coalesce(CAST(h[i + {i}] AS HUGEINT), 0) * {MULTIPLIERS[i]} % {P}" for i in range(SHINGLE))
ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS source, list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != ''), lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT)) AS h
  FROM documents
), s AS (
  SELECT doc_id, source, h, unnest(CASE WHEN len(h) = 0 THEN [] ELSE generate_series(1, greatest(len(h) - {SHINGLE - 1}, 1)) END) AS i FROM w
), x AS (
  SELECT DISTINCT doc_id, source, CAST(({_TERMS}) % {P} AS BIGINT) AS x FROM s
), d AS (
  SELECT w.doc_id, w.source, coalesce((list_sort(list(x.x) FILTER (WHERE x.x IS NOT NULL)))[1:{K}], []) AS a FROM w LEFT JOIN x ON w.doc_id = x.doc_id GROUP BY w.doc_id, w.source
), g AS (
  SELECT source, list_sort(list(x))[1:{GROUP_K}] AS b FROM (SELECT DISTINCT source, x FROM x) GROUP BY source
), j AS (
  SELECT d.*, coalesce(b, []) AS b, least(CASE WHEN len(a) >= {K} THEN a[-1] ELSE {P} END, CASE WHEN len(b) >= {GROUP_K} THEN b[-1] ELSE {P} END) AS top FROM d LEFT JOIN g USING (source)
), c AS (
  SELECT *, list_filter(a, lambda x: x <= top) AS ca, list_filter(b, lambda x: x <= top) AS cb FROM j
), n AS (
  SELECT *, CAST(len(list_intersect(ca, cb)) AS DOUBLE) AS n_both FROM c
)
SELECT doc_id, source, CAST(len(a) AS INTEGER) AS n_hashes, array_to_string(a, ',') AS sketch,
  round(CASE WHEN len(a) >= {K} THEN CAST({K - 1} AS DOUBLE) * CAST({P} AS DOUBLE) / CAST(a[-1] AS DOUBLE) ELSE CAST(len(a) AS DOUBLE) END, 3) AS "distinct",
  round(CASE WHEN len(b) >= {GROUP_K} THEN CAST({GROUP_K - 1} AS DOUBLE) * CAST({P} AS DOUBLE) / CAST(b[-1] AS DOUBLE) ELSE CAST(len(b) AS DOUBLE) END, 3) AS group_distinct,
  round(CASE WHEN len(ca) + len(cb) = 0 THEN 1 ELSE n_both / (len(ca) + len(cb) - n_both) END, 9) AS resemblance, round(CASE WHEN len(ca) = 0 THEN 1 ELSE n_both / len(ca) END, 9) AS containment
FROM n
"""
PAIRS_ORACLE = f"""
WITH w AS (
  SELECT coalesce(source, '') AS source, list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != ''), lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT)) AS h
  FROM documents
), s AS (
  SELECT source, h, unnest(CASE WHEN len(h) = 0 THEN [] ELSE generate_series(1, greatest(len(h) - {SHINGLE - 1}, 1)) END) AS i FROM w
), x AS (
  SELECT DISTINCT source, CAST(({_TERMS}) % {P} AS BIGINT) AS x FROM s
), g AS (
  SELECT source, coalesce(l, []) AS a, CASE WHEN len(l) >= {GROUP_K} THEN l[-1] ELSE {P} END AS top,
    CASE WHEN len(l) >= {GROUP_K} THEN round(CAST({GROUP_K - 1} AS DOUBLE) * CAST({P} AS DOUBLE) / CAST(l[-1] AS DOUBLE), 3) ELSE coalesce(len(l), 0) END AS n
  FROM (SELECT DISTINCT source FROM w) LEFT JOIN (SELECT source, list_sort(list(x))[1:{GROUP_K}] AS l FROM x GROUP BY source) USING (source)
), j AS (
  SELECT p.source, o.source AS other, p.n, o.n AS other_n, p.a, list_filter(p.a, lambda x: x <= least(p.top, o.top)) AS ca, list_filter(o.a, lambda x: x <= least(p.top, o.top)) AS cb
  FROM g p JOIN g o ON p.source != o.source
), n AS (
  SELECT *, CAST(len(list_intersect(ca, cb)) AS DOUBLE) AS n_both FROM j
)
SELECT source, other, CAST(n AS DOUBLE) AS "distinct", CAST(other_n AS DOUBLE) AS other_distinct, CAST(len(ca) AS INTEGER) AS n_sampled,
  round(CASE WHEN len(ca) + len(cb) = 0 THEN 1 ELSE n_both / (len(ca) + len(cb) - n_both) END, 9) AS resemblance, round(CASE WHEN len(a) = 0 THEN 1 WHEN len(ca) > 0 THEN n_both / len(ca) END, 9) AS containment
FROM n
"""
