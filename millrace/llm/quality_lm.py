"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .blobs import SCHEMA, by_shard, pack, shard_of, unpack
from .common import Table, as_text, doc_id, fresh, join_small, mix, pieces, shards, text_bytes, text_hash, worker, written

ORDER = 5
#: Of the trusted documents one in CALIBRATE, by the hash of its id, calibrates and isn't trained on; all others are.
CALIBRATE = 5
#: The quantile of the calibrating documents' log perplexity in a language above which a document is rejected, read to the next 1/GRID bit above it.
HIGH, GRID = 0.995, 4096
PACK_BYTES, SHARD_BYTES = 16 << 20, 32 << 20
#: Bits of the bitmap of training ids for each of them, and at most (16 MB). Documents that it doesn't have aren't shuffled; those that it has by chance are, and are left out then.
ID_BITS, MAX_BITS = 32, 1 << 27
_SEGMENT = 1 << 20


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each text behind ORDER - 1 zero bytes, and where they start with those."""
    texts = as_text(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = off - off[0] + (ORDER - 1) * np.arange(len(off))
    out = np.zeros(at[-1], np.uint8)
    for i in range(len(texts)):
        out[at[i] + ORDER - 1 : at[i + 1]] = raw[off[i] : off[i + 1]]
    return out, at


def _keys(padded: np.ndarray, a: int, b: int) -> np.ndarray:
    """The n-grams that end at [a, b), each as one integer, its last byte lowest."""
    key = padded[a - ORDER + 1 : b - ORDER + 1].astype(np.uint64)
    for k in range(1, ORDER):
        key <<= np.uint64(8)
        key |= padded[a - ORDER + 1 + k : b - ORDER + 1 + k]
    return key


def _segments(padded: np.ndarray, at: np.ndarray, chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, the document of each) of the chosen documents, a few million at a time."""
    pad = np.zeros(len(padded), bool)
    for k in range(ORDER - 1):
        pad[at[:-1] + k] = True
    for a in range(ORDER - 1, len(padded), _SEGMENT):
        b = min(a + _SEGMENT, len(padded))
        doc = np.searchsorted(at, np.arange(a, b), side="right") - 1 if chosen is not None else None
        real = ~pad[a:b] if chosen is None else ~pad[a:b] & chosen[doc]
        yield _keys(padded, a, b)[real], real


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    """By the last three bytes of the context: all counts that a probability needs are then in one shard, but for those of three bytes and fewer, which all shards have. A frequent pair of bytes is in many."""
    return shard_of(mix(keys >> np.uint64(8) & np.uint64(0xFFFFFF)), n)


def _distinct(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = np.empty(0, np.uint64)
    for keys, _ in _segments(padded, at):
        found = np.unique(np.concatenate([found, np.unique(keys)]))
    return found


def _frozen(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about PACK_BYTES of text, which is the second column."""
    held, size = [], 0
    for b in pieces(batches):
        held.append(b)
        size += pc.sum(pc.binary_length(as_text(b.column(1)))).as_py()
        if size > PACK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _packs(n: int):
    """Packs of documents: their texts, and their n-grams as requests to the shards."""

    def rows(kind: str, name: str, batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(b)), pa.array([name] * len(b)), b.column(0), b.column(1)], ["kind", "pack", "shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            name = uuid.uuid4().hex
            yield pa.RecordBatch.from_arrays([pa.array(["docs"]), pa.array([name]), pa.array([-1], pa.int32()), pa.array([_frozen(t)], pa.binary())], ["kind", "pack", "shard", "blob"])
            padded, at = _padded(t.column(1))
            keys = _distinct(padded, at)
            yield from rows("asked", name, by_shard(_shard(keys, n), [keys.view(np.int64)]))

    return run


def _maybe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Of docs (doc_id, text) those that a bitmap of the ids (__mr_doc) has: all that are among the ids, and some that aren't. What is broadcast has at most MAX_BITS."""
    bits = min(MAX_BITS, 1 << (ID_BITS * ids.count()).bit_length())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bitmap = ids.groupBy(F.bitmap_bucket_number(slot("__mr_doc")).alias("__mr_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot("__mr_doc"))).alias("__mr_bits"))
    d = docs.where("doc_id IS NOT NULL").withColumn("__mr_at", F.bitmap_bit_position(slot("doc_id")).cast("int"))
    d = d.join(F.broadcast(bitmap), F.bitmap_bucket_number(slot("doc_id")) == F.col("__mr_bucket"))
    return d.where("shiftright(CAST(conv(hex(substr(__mr_bits, CAST(__mr_at DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), __mr_at % 8) & 1 = 1").select("doc_id", "text")


def _part(ids: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    return shard_of(mix(ids.to_numpy()), n)


def _ids_by_part(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from by_shard(_part(b.column(0), n), [b.column(0).to_numpy()])

    return run


def _texts_by_part(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            part = _part(t.column(0), n)
            order = np.argsort(part, kind="stable")
            t, (parts, start) = t.take(pa.array(order)).combine_chunks(), np.unique(part[order], return_index=True)
            ends = [*start[1:].tolist(), len(order)]
            for p, i, j in zip(parts.tolist(), start.tolist(), ends):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_frozen(t.slice(i, j - i))], pa.binary())], ["shard", "blob"])

    return run


def _counts(n: int):
    """Counts of the n-grams in the texts of a part whose ids are among the part's, which come first."""

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = [], None
        for b in batches:
            for first, blob in zip(b.column(0).to_pylist(), b.column(2)):
                raw = blob.as_buffer().to_pybytes()
                if first == 0:
                    ids.append(unpack(raw)[0])
                    continue
                known = np.concatenate([np.empty(0, np.int64), *ids]) if known is None else known
                t = pa.ipc.open_stream(raw).read_all()
                yield from t.filter(pa.array(np.isin(t.column(0).to_numpy(), known))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(training(batches)):
            padded, at = _padded(t.column(1))
            parts = [np.unique(k, return_counts=True) for k, _ in _segments(padded, at)]
            keys, counts = _summed([p[0] for p in parts], [p[1] for p in parts])
            yield from by_shard(_shard(keys, n), [keys.view(np.int64), counts.astype(np.int64)])

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[start], np.add.reduceat(c, start) if len(k) else c


def _lower(keys: np.ndarray, bytes_left: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of distinct n-grams, and how many different bytes come before each."""
    return np.unique(keys & np.uint64((1 << 8 * bytes_left) - 1), return_counts=True)


def _count_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's counts over all packs; for the whole model's discounts how many n-grams of orders above 3 occur 1, 2, 3 and 4 times; and the bytes before each three, of those that this shard has."""
    keys, counts, shard = np.empty(0, np.uint64), np.empty(0, np.int64), None
    for b in batches:
        parts = [unpack(x.as_buffer().to_pybytes()) for x in b.column(1)]
        shard = b.column(0)[0].as_py() if b.num_rows else shard
        keys, counts = _summed([keys, *[p[0].view(np.uint64) for p in parts]], [counts, *[p[1] for p in parts]])
    if shard is None:
        return
    kind, key, n = [], [], []
    level, c = keys, counts
    for order in range(ORDER, 3, -1):
        for times in range(1, 5):
            kind.append(order)
            key.append(times)
            n.append(int((c == times).sum()))
        level, c = _lower(level, order - 1)
    kind += [0] * len(level)
    key += level.astype(np.int64).tolist()
    n += c.tolist()
    size = len(kind)
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *kind], pa.int32()), pa.array([shard, *key], pa.int64()), pa.array([0, *n], pa.int64()), pa.array([pack([keys.view(np.int64), counts]), *[None] * size], pa.binary())],
        ["what", "key", "n", "blob"],
    )


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts of 0, 1, 2, and 3 or more, from the numbers of n-grams that occur 1 to 4 times; 0.5, 1 and 1.5 where those don't give one above 0.

    A discount of 0 would leave nothing for what is unseen: its probability would be 0, and the perplexity infinite.
    """
    usual = np.array([0, 0.5, 1, 1.5])
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return usual
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((d > 0) & (d < [1, 1, 2, 3]), d, usual)


@dataclass
class Low:
    """What all shards share: the discounts of each order above 2, p(byte | byte before), and of the distinct runs of three bytes, 2^24 at most, what Level has."""

    d: dict[int, np.ndarray]
    p2: np.ndarray
    three: tuple

    @staticmethod
    def fit(keys: np.ndarray, before: np.ndarray, times: dict[int, np.ndarray]) -> "Low":
        """keys: runs of three bytes, sorted; before: how many different bytes come before each; times: of each order above 3, how many n-grams occur 1 to 4 times."""
        pair, n = _lower(keys, 2)
        c = np.zeros(1 << 16)
        c[pair.astype(np.int64)] = n
        c = c.reshape(256, 256)
        singles = (c > 0).sum(0).astype(float)
        p1 = _interpolate(singles[None, :], np.full((1, 256), 1 / 256), discounts(_times(singles)))[0]
        d = {k: discounts(n) for k, n in times.items()} | {3: discounts(_times(before))}
        return Low(d, _interpolate(c, np.broadcast_to(p1, (256, 256)), discounts(_times(c))), _level(keys, before, d[3]))


def _level(level: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple:
    """(n-grams, their counts less the discount, contexts, each one's total and the sum of its discounts)."""
    context, at = np.unique(level >> np.uint64(8), return_index=True)
    off = d[np.minimum(c, 3)]
    sums = (np.add.reduceat(c, at).astype(float), np.add.reduceat(off, at)) if len(c) else (np.empty(0), np.empty(0))
    return level, c - off, context, *sums


def _times(c: np.ndarray) -> np.ndarray:
    return np.array([(c == k).sum() for k in range(1, 5)])


def _interpolate(c: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    total = c.sum(1, keepdims=True)
    off = d[np.minimum(c, 3).astype(int)]
    with np.errstate(invalid="ignore", divide="ignore"):
        p = (c - off + off.sum(1, keepdims=True) * lower) / total
    return np.where(total > 0, p, lower)


class Model:
    """One shard's probabilities, the shard's n-gram counts given."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: Low):
        self.low, self.levels = low, [(3, *low.three)]
        level, c = keys, counts
        for order in range(ORDER, 3, -1):
            self.levels.insert(1, (order, *_level(level, c, low.d[order])))
            level, c = _lower(level, order - 1)

    def log2(self, keys: np.ndarray) -> np.ndarray:
        p = self.low.p2.reshape(-1)[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        for order, level, less, context, total, off in self.levels:
            k = keys & np.uint64((1 << 8 * order) - 1)
            i, known = _find(context, k >> np.uint64(8))
            j, seen = _find(level, k)
            if len(level):
                p = np.where(known, (np.where(seen, less[j], 0) + off[i] * p) / total[i], p)
        return np.log2(p)


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return i, sorted_[i] == x


def _answers(shared):
    """The probabilities that the packs ask of a shard; its counts come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, low = None, shared.value
        for b in batches:
            for first, name, shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                columns = unpack(blob.as_buffer().to_pybytes())
                if first == 0:
                    model = Model(columns[0].view(np.uint64), columns[1], low)
                    continue
                model = model or Model(np.empty(0, np.uint64), np.empty(0, np.int64), low)
                answer = pack([model.log2(columns[0].view(np.uint64)).astype(np.float32).view(np.uint32)])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard], pa.int32()), pa.array([answer], pa.binary())], ["pack", "shard", "blob"])

    return run


_SCORED = "doc_id long, th long, lang string, n_bytes long, log2_ppl double"


def _score(n: int):
    def emit(docs: bytes, answers: list[np.ndarray]) -> pa.RecordBatch:
        t = pa.ipc.open_stream(docs).read_all().combine_chunks()
        padded, at = _padded(t.column(1))
        keys = _distinct(padded, at)
        logs = np.empty(len(keys), np.float32)
        logs[np.argsort(_shard(keys, n), kind="stable")] = np.concatenate([*answers, np.empty(0, np.float32)])
        size = np.diff(at) - (ORDER - 1)
        end, sums, pos, total = np.cumsum(size), np.zeros(len(size)), 0, 0.0
        for k, _ in _segments(padded, at):
            run = total + np.cumsum(logs[np.searchsorted(keys, k)], dtype=np.float64)
            i, j = np.searchsorted(end, [pos, pos + len(k)], side="right")
            sums[i:j] = run[end[i:j] - pos - 1]
            pos, total = pos + len(k), run[-1] if len(k) else total
        with np.errstate(invalid="ignore"):
            ppl = -np.diff(sums, prepend=0.0) / size
        return pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), t.column(2).combine_chunks(), t.column(3).combine_chunks(), pa.array(size), pa.array(ppl, mask=size == 0)], ["doc_id", "th", "lang", "n_bytes", "log2_ppl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, docs, answers = None, None, []
        for b in batches:
            for name, shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if name != last:
                    if docs is not None:
                        yield emit(docs, answers)
                    last, docs, answers = name, None, []
                raw = blob.as_buffer().to_pybytes()
                if shard < 0:
                    docs = raw
                else:
                    answers.append(unpack(raw)[0].view(np.float32))
        if docs is not None:
            yield emit(docs, answers)

    return run


def trusted(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(__mr_doc, __mr_role): documents that all their labels call good and not toxic; role 2, one in CALIBRATE, calibrates, and all others, 1, train.

    Given most, only so many train, those with the least hashes, and the rest calibrates, too.
    """
    ids = labels.groupBy(doc_id(labels, "doc_id").alias("__mr_doc")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0 AND __mr_doc IS NOT NULL")
    ids = ids.select("__mr_doc", F.xxhash64("__mr_doc").alias("h"))
    trains = F.pmod("h", F.lit(CALIBRATE)) != 0
    if most is None:
        return ids.select("__mr_doc", F.when(trains, 1).otherwise(2).alias("__mr_role"))
    training = ids.where(trains).orderBy("h", "__mr_doc").limit(most).select(F.col("__mr_doc").alias("__mr_trains"))
    return ids.join(training, F.col("__mr_doc") == F.col("__mr_trains"), "left").select("__mr_doc", F.when(F.col("__mr_trains").isNull(), 2).otherwise(1).alias("__mr_role"))


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int | None = None) -> DataFrame | None:
    """(doc_id, th, lang, role, n_bytes, log2_ppl) for each row, from written scores; None if no trusted document is among docs."""
    spark = docs.sparkSession
    ids = written(trusted(labels, most))
    d = docs.select(doc_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    n = shards(spark, text_bytes(docs, text_col), SHARD_BYTES)
    # training ids grow with the table, so they meet their texts by a shuffle at every size
    training = ids.where("__mr_role = 1").select("__mr_doc")
    texts = _maybe(d.select("doc_id", "text"), training).transform(worker, _texts_by_part(n), SCHEMA).select(F.lit(1).alias("first"), "shard", "blob")
    chosen = training.transform(worker, _ids_by_part(n), SCHEMA).select(F.lit(0).alias("first"), "shard", "blob").union(texts)
    counts = chosen.repartitionById(n, F.col("shard")).sortWithinPartitions("first").transform(worker, _counts(n), SCHEMA)
    counted = Table(counts.repartitionById(n, F.col("shard")).transform(worker, _count_shard, "what int, key long, n long, blob binary"))
    sums = counted.read().where("what >= 0").groupBy("what", "key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")  # at most 2^24 runs of three bytes and 8 numbers
    if not len(sums):
        return None
    own = sums[sums.what == 0]
    low = Low.fit(own.key.to_numpy().astype(np.uint64), own.n.to_numpy(), {k: sums[sums.what == k].n.to_numpy() for k in range(4, ORDER + 1)})
    low = spark.sparkContext.broadcast(low)
    packs = Table(d.transform(worker, _packs(n), "kind string, pack string, shard int, blob binary"), "kind")
    model = counted.read().where("what = -1").select(F.lit(0).alias("first"), F.lit("").alias("pack"), F.col("key").cast("int").alias("shard"), "blob")
    asked = packs.read().where("kind = 'asked'").select(F.lit(1).alias("first"), "pack", "shard", "blob")
    answers = model.union(asked).repartitionById(n, F.col("shard")).sortWithinPartitions("first").transform(worker, _answers(low), "pack string, shard int, blob binary")
    texts = packs.read().where("kind = 'docs'").select("pack", "shard", "blob")
    scored = Table(texts.union(answers).repartition(n, "pack").sortWithinPartitions("pack", "shard").transform(worker, _score(n), _SCORED))
    packs.drop()
    counted.drop()
    s = join_small(scored.read(), ids, F.col("doc_id") == F.col("__mr_doc"), "left")
    return s.select("doc_id", "th", "lang", F.coalesce("__mr_role", F.lit(0)).cast("int").alias("role"), "n_bytes", "log2_ppl")


def limits(scored: DataFrame) -> DataFrame:
    """(lang, most): the log perplexity up to which a language's documents are kept, HIGH of its calibrating ones at least; lang null: that of all languages.

    Counts by language and 1/GRID bit, added up from below: exact to that grid, and no task holds a language's documents.
    """
    bucket = F.ceil(F.col("log2_ppl") * GRID)
    c = written(scored.where("role = 2 AND log2_ppl IS NOT NULL").groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n")))
    every = c.groupBy("bucket").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bucket", "n")
    w = Window.partitionBy("lang")
    upto, total = F.sum("n").over(w.orderBy("bucket")), F.sum("n").over(w)
    return c.union(every).select("lang", "bucket", upto.alias("upto"), total.alias("total")).where(F.col("upto") >= F.lit(HIGH) * F.col("total")).groupBy("lang").agg((F.min("bucket") / GRID).alias("most"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int | None = None) -> DataFrame:
    """One row (doc_id, th, lang, n_bytes, perplexity, rejected) for each row of docs.

    The model is of bytes, order ORDER, interpolated modified Kneser-Ney, over all bytes of the trusted documents: those whose labels all
    say quality 1 and toxic 0. One in CALIBRATE isn't trained on; the quantile HIGH of all these per language
    is the limit above which a document is rejected. All others are trained on, however many they are, unless most is given. The perplexity is per byte, over the whole text.

    The texts of training documents are joined with their ids by a shuffle, after a bitmap of bounded size has left out most others, and counted. Packs of documents gather their distinct n-grams, all over the corpus; these requests and the training counts are joined shard by shard, a shard having all
    n-grams whose contexts end in the same three bytes, and the answers go back to the packs. What moves grows with the input; what is
    broadcast, the counts of runs of three bytes and the bitmap, has at most 2^24 entries and 16 MB.

    Null and empty texts have a null perplexity and are rejected. A null language counts as "". Languages without calibrating documents
    go by the limit of all. Rows that repeat are scored alike; ids may be null, and have to be of a whole-number type (else a TypeError). Without any trusted document among docs nothing but
    empty texts is rejected, and perplexity is null. An empty table gives no rows.
    """
    scored = perplexities(docs, labels, id_col, text_col, lang_col, most)
    if scored is None:
        return docs.select(doc_id(docs, id_col).alias("doc_id"), text_hash(text_col).alias("th"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), (F.coalesce(F.length(text_col), F.lit(0)) == 0).alias("rejected"))
    found = written(limits(scored))
    every = found.where("lang IS NULL").agg(F.max("most").alias("m0"))
    own = found.where("lang IS NOT NULL").withColumnRenamed("lang", "__mr_lang")
    s = join_small(scored, own, F.col("lang") == F.col("__mr_lang"), "left").crossJoin(F.broadcast(every))  # one row
    inside = F.col("log2_ppl") <= F.coalesce("most", "m0", F.lit(1e300))
    return s.select("doc_id", "th", "lang", "n_bytes", F.pow(F.lit(2.0), "log2_ppl").alias("perplexity"), (~F.coalesce(inside, F.lit(False))).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, all columns of any name, without the rows that classify rejects."""
    doc, th, key = fresh(docs, "__doc", "__th", "__key")
    gone = written(classify(docs, labels, id_col, text_col, lang_col).where("rejected").select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct())
    return join_small(docs.withColumn(key, text_hash(text_col)), gone, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left_anti").drop(key)
