"""SimHash near-dedup with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .blobs import SCHEMA, by_shard, groups, per_shard, shard_of
from .common import doc_id, fresh, join_hot, join_small, mix, pieces, shards, text_hash, words, worker, written
from .components import components

BITS, HALF, HALF_RADIUS = 128, 64, 7
#: Prints within this distance are found without exception: one half then differs in at most HALF_RADIUS bits.
RADIUS = 2 * HALF_RADIUS + 1
#: Prints whose keys a shard holds, about; prints of a group that are compared with as many others at once.
SHARD_NODES, BLOCK = 2000, 2048
_PUNCTUATION = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"


def covering_masks() -> np.ndarray:
    """The 255 masks of 64 bits that cover radius 7.

    Bit i has a vector of 8 bits; mask v has bit i where their inner product is odd. Any 7 differing bits give 7
    equations for v, so some v that isn't 0 masks them all out. The vectors, (1, i, q(i)) with q a bent function, make
    a code of least weight 28: every mask compares 28 bits at least.
    """
    i = np.arange(HALF)
    x = [(i >> k) & 1 for k in range(6)]
    rows = [np.ones(HALF, int), *x, (x[0] & x[1]) ^ (x[2] & x[3]) ^ (x[4] & x[5])]
    weight = np.array([1 << int(k) for k in range(HALF)], np.uint64)
    masks = []
    for v in range(1, 1 << (HALF_RADIUS + 1)):
        bits = sum(rows[k] for k in range(HALF_RADIUS + 1) if v >> k & 1) % 2
        masks.append(np.bitwise_or.reduce(weight[bits == 1]))
    return np.array(masks, np.uint64)


def simhash(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of each text's print, and its number of different words.

    Words lower-cased, without punctuation at their ends; weights int(16 log2(1 + occurrences)); bit k is whether the weighted sum of the
    words' hash bits, as signs, is above 0. Sums are of integers, so they don't depend on the order. Words of punctuation only, such as a
    table's bars, count only in texts that have no others.
    """
    codes, distinct, off = words(texts, lower=True)
    index: dict[str, int] = {}
    to = np.fromiter((index.setdefault(w.strip(_PUNCTUATION) or w, len(index)) for w in distinct), np.int64, len(distinct))
    n = len(off) - 1
    digest = xxhash.xxh3_128_digest
    raw = np.frombuffer(b"".join([digest(w) for w in index]), np.uint8).reshape(-1, BITS // 8)
    signs = np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    key, count = np.unique(doc * max(len(index), 1) + to[codes], return_counts=True) if len(codes) else (np.empty(0, np.int64), np.empty(0, np.int64))
    word = key % max(len(index), 1)
    at = np.searchsorted(key // max(len(index), 1), np.arange(n + 1))
    weight = (16 * np.log2(1 + count)).astype(np.int64).astype(np.float32)
    marks = np.fromiter((not w.strip(_PUNCTUATION) for w in index), bool, len(index))[word]
    worded = np.bincount((key // max(len(index), 1))[~marks], minlength=n) > 0
    weight[marks & worded[key // max(len(index), 1)]] = 0
    sums = np.zeros((n, BITS), np.float32)
    for i in range(n):
        if at[i] < at[i + 1]:
            sums[i] = weight[at[i] : at[i + 1]] @ signs[word[at[i] : at[i + 1]]]
    halves = np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64)
    return halves[:, 0], halves[:, 1], np.diff(at)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, limit=2 << 20):
        f1, f2, n = simhash(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(n, pa.int32())], ["doc_id", "th", "f1", "f2", "n_words"])


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, f1, f2, n_words) for each row; null and wordless texts have 0 words."""
    return docs.select(doc_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th")).transform(worker, _prints, "doc_id long, th long, f1 long, f2 long, n_words int")


def _table_keys(n: int):
    masks = covering_masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 5000):
                b = whole.slice(i, 5000)
                node = np.sort(b.column(0).to_numpy())
                order = np.argsort(b.column(0).to_numpy(), kind="stable")
                keys = []
                for half in (1, 2):
                    f = b.column(half).to_numpy()[order].view(np.uint64)
                    salt = mix(np.arange(len(masks), dtype=np.uint64) + np.uint64(half << 20))
                    keys.append(mix((f[:, None] & masks[None, :]) ^ salt[None, :]))
                h = np.concatenate(keys, axis=1)
                per = h.shape[1]
                yield from by_shard(shard_of(h.reshape(-1), n), [h.reshape(-1).astype(np.uint32), np.repeat(node, per)])

    return run


def _collisions(shard: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    h, node = columns
    order, _, group = groups(h)
    shared = order[np.bincount(group)[group] > 1] if len(h) else order
    for i in range(0, len(shared), 200_000):
        s = shared[i : i + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(h[s].astype(np.int64) | np.int64(shard) << 32), pa.array(node[s])], ["bucket", "node"])


def distances(a1, a2, b1, b2) -> np.ndarray:
    return np.bitwise_count(a1 ^ b1).astype(np.int32) + np.bitwise_count(a2 ^ b2)


def _forest(node: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> tuple[list, list]:
    """Edges that connect what is connected by pairs within the radius: each member, found breadth first, to its group's first."""
    left, a, b = np.arange(len(node)), [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = distances(f1[left], f2[left], f1[at], f2[at]) <= RADIUS
            found, left = left[near], left[~near]
            queue += found.tolist()
            a += [node[root]] * len(found)
            b += node[found].tolist()
    return a, b


def _runs(batches: Iterator[pa.RecordBatch], keys: int, work) -> Iterator[pa.RecordBatch]:
    """work on the rows of some whole runs of equal first columns at a time; rows come sorted by those."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not len(t):
            continue
        same = np.ones(len(t), bool)
        for k in range(keys):
            x = t.column(k).to_numpy()
            same &= x == x[-1]
        cut = len(t) - int(same[::-1].argmin()) if not same.all() else 0  # the last run may go on
        rest = t.slice(cut)
        if cut:
            yield from work(t.slice(0, cut).combine_chunks())
    if rest is not None and len(rest):
        yield from work(rest.combine_chunks())


def _edges(t: pa.Table) -> Iterator[pa.RecordBatch]:
    bucket, node = t.column(0).to_numpy(), t.column(1).to_numpy()
    f1, f2 = t.column(2).to_numpy().view(np.uint64), t.column(3).to_numpy().view(np.uint64)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([start, [len(bucket)]]))
    two = start[size == 2]
    near = two[distances(f1[two], f2[two], f1[two + 1], f2[two + 1]) <= RADIUS]
    a, b = [node[near]], [node[near + 1]]
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        x, y = _forest(node[s : s + n], f1[s : s + n], f2[s : s + n])
        a.append(np.array(x, np.int64))
        b.append(np.array(y, np.int64))
    pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    if pair.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


def _links(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """For runs of (root, i, j) with the prints of blocks i and j: how many of the other block's each print is near to, itself not counted."""
    root, i, j, block = (t.column(k).to_numpy() for k in range(4))
    node = t.column(4).to_numpy()
    f1, f2 = (t.column(k).to_numpy().view(np.uint64) for k in (5, 6))
    new = np.ones(len(root), bool)
    new[1:] = (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    start = np.flatnonzero(new)
    found = np.zeros(len(root), np.int64)
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(root)]):
        left = s + np.flatnonzero(block[s:e] == i[s])
        right = s + np.flatnonzero(block[s:e] == j[s])
        for k in range(0, len(left), 256):
            part = left[k : k + 256]
            near = distances(f1[part, None], f2[part, None], f1[None, right], f2[None, right]) <= RADIUS
            found[part] += near.sum(1)
            if i[s] == j[s]:
                found[part] -= 1
            else:
                found[right] += near.sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found)], ["node", "links"])


def near_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of written nodes (node, f1, f2) within RADIUS."""
    n = shards(nodes.sparkSession, nodes.count(), SHARD_NODES)
    keys = nodes.transform(worker, _table_keys(n), SCHEMA)
    hits = per_shard(keys, n, _collisions, "bucket long, node long")
    found = hits.join(nodes, "node").select("bucket", "node", "f1", "f2")
    return found.repartition("bucket").sortWithinPartitions("bucket", "node").transform(worker, lambda batches: _runs(batches, 1, _edges), "a long, b long")


def near_links(members: DataFrame) -> DataFrame:
    """(node, links) of written members (root, size, node, f1, f2): with how many others of its group each is within RADIUS.

    A group's prints are in blocks of about BLOCK, and each pair of blocks, one of them twice included, is compared by itself: however large a group is, no task holds it.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    m = members.where("size > 1").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("f1", "f2"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "f1", "f2")
    return m.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").transform(worker, lambda batches: _runs(batches, 3, _links), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, th, group_id, keep, n_links, f1, f2) for each document: group_id is the least id of its group of near copies, keep whether it is the group's first document.

    Groups are the connected components of all pairs whose 128-bit SimHashes differ in at most RADIUS = 15 bits. Equal prints are collapsed first,
    so exact copies, however many, are one node. For the others each half of the print has 255 tables, keyed by
    its bits under the covering masks; a pair within the radius has a half within 7, and so collides in some table without
    exception. Keys travel as 4 bytes and about 2 for the node; what collides is compared by whole prints. n_links: how many different prints
    are within the radius of the document's, counted in its group block by block; copies aren't expanded into pairs. No caps.

    Documents are in the order of id, then hash of the text. An id with several texts is several documents, rows that repeat an id and its
    text are one. A null or wordless text is in no group: group_id is its own id. A null id has a null group and is kept; neither has links. Ids of another than a
    whole-number type are a TypeError. An empty table gives no rows.
    """
    p = written(prints(docs, id_col, text_col).dropDuplicates(["doc_id", "th"]))
    real = p.where("n_words > 0 AND doc_id IS NOT NULL")
    same = real.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("copies"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()))
    roots = components(near_edges(nodes.select("node", "f1", "f2")))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted)
    least = written(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("size")))
    members = written(join_hot(rooted, least, ["root"], "size"))
    links = near_links(members.select("root", "size", "node", "f1", "f2"))
    found = written(members.join(links, "node", "left").select("f1", "f2", "copies", "least", F.coalesce("links", F.lit(0).cast("long")).alias("n_links")))
    first = (F.col("least.doc_id") == F.col("doc_id")) & (F.col("least.th") == F.col("th"))
    g = join_hot(real, found, ["f1", "f2"], "copies").select("doc_id", "th", F.col("least.doc_id").alias("group_id"), first.alias("keep"), "n_links", "f1", "f2")
    alone = p.where("n_words = 0 OR doc_id IS NULL").select("doc_id", "th", F.col("doc_id").alias("group_id"), F.lit(True).alias("keep"), F.lit(0).cast("long").alias("n_links"), "f1", "f2")
    return g.unionByName(alone)


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns of any name, with the first document of each group, by id and then hash of the text. Of rows that repeat it that of the least hash of all columns (but maps) stays."""
    doc, th, key = fresh(docs, "__doc", "__th", "__key")
    gone = written(near_groups(docs, id_col, text_col).where("NOT keep").select(F.col("doc_id").alias(doc), F.col("th").alias(th)))
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th))
    kept = join_small(docs.withColumn(key, text_hash(text_col)), gone, same, "left_anti")
    twice = docs.select(F.col(id_col).alias(doc), text_hash(text_col).alias(th)).where(F.col(doc).isNotNull()).groupBy(doc, th).count().where("count > 1").select(doc, th)
    twice = written(twice)
    if twice.isEmpty():
        return kept.drop(key)
    once = join_small(kept, twice, same, "left_anti").drop(key)
    whole = F.xxhash64(*[f.name for f in docs.schema.fields if not f.dataType.simpleString().count("map<")])
    one = join_small(kept, twice, same, "left_semi").groupBy(id_col, key).agg(F.min_by(F.struct(*docs.columns), whole).alias(doc)).select(f"{doc}.*")
    return once.unionByName(one)
