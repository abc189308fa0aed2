"""Best-fit packing: documents into sequences by bin completion."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import doc_id, join_small, worker, written

CAPACITY = 2048
#: Nodes of the search; beyond them the best packing found so far stands, and n_bins and min_bins say how near it is.
MAX_NODES = 2000
#: Steps of a node's enumeration without a filling that count as a node.
STEPS = 10_000

Pattern = tuple[tuple[int, ...], int]  # lengths, falling, and how many bins are filled so


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: each length, falling, goes to the fullest bins that it fits."""
    rooms: list[int] = []  # rising
    bins: dict[int, list[list]] = {}  # room: [lengths, how many]

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
            bins[room] = []
        bins[room].append([lengths, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                fit = capacity // length
                if left >= fit:
                    put(capacity - fit * length, (length,) * fit, left // fit)
                    left %= fit
                else:
                    put(capacity - left * length, (length,) * left, 1)
                    left = 0
                continue
            room = rooms[k]
            have = bins[room]
            lengths, n = have[-1]
            fit = min(room // length, left)  # the same bins stay the fullest that fit
            take = min(n, left // fit)
            if take == n:
                have.pop()
                if not have:
                    del bins[room]
                    rooms.pop(k)
            else:
                have[-1][1] -= take
            put(room - fit * length, lengths + (length,) * fit, take)
            left -= take * fit
    return [(lengths, n) for room in bins for lengths, n in bins[room]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer bins."""
    lengths = sorted(counts)
    total = sum(x * n for x, n in counts.items())
    best = -(-total // capacity)
    n = np.array([counts[x] for x in lengths])
    x = np.array(lengths)
    for k in lengths:
        if 2 * k > capacity:
            break
        big = x > capacity - k
        middle = (x <= capacity - k) & (2 * x > capacity)
        small = (2 * x <= capacity) & (x >= k)
        room = int((n[middle] * (capacity - x[middle])).sum())
        more = max(0, -(-(int((n[small] * x[small]).sum()) - room) // capacity))
        best = max(best, int(n[big].sum() + n[middle].sum()) + more)
    return best


def completions(counts: dict[int, int], lengths: list[int], room: int, waste: int) -> Iterator[tuple[int, ...] | None]:
    """Fillings of room, falling lengths, that waste at most so much and that no other dominates: those of least waste first, then those of fewer, larger pieces.

    A filling is dominated if one larger piece that is left fits for one of its pieces, or another piece still fits. Each is found when it is asked for;
    only sums that the lengths left can make are followed. None comes after each STEPS steps without one.
    """
    reach = [1] * (len(lengths) + 1)  # bit r: some of the lengths from k on make r
    for k in range(len(lengths) - 1, -1, -1):
        x, r, left, part = lengths[k], reach[k + 1], min(counts[lengths[k]], room // lengths[k]), 1
        while left:
            n = min(part, left)
            r |= r << x * n
            left, part = left - n, 2 * part
        reach[k] = r & (1 << room + 1) - 1
    steps = 0
    for w in range(min(waste, room) + 1):
        if not reach[0] >> room - w & 1:
            continue
        stack: list[tuple[int, int, tuple[int, ...], int]] = [(0, room - w, (), room + w + 1)]
        while stack:
            k, rest, chosen, near = stack.pop()  # near: the least of the longer lengths of which some are left
            steps += 1
            if steps >= STEPS:
                steps = 0
                yield None
            if not rest:
                if k == len(lengths) or lengths[-1] > w:
                    steps = 0
                    yield chosen
                continue
            x = lengths[k]
            for n in range(min(counts[x], rest // x) + 1):
                if reach[k + 1] >> rest - n * x & 1 and (not n or near > x + w) and (x > w or n == counts[x]):
                    stack.append((k + 1, rest - n * x, chosen + (x,) * n, x if n < counts[x] else near))


def pack(counts: dict[int, int], capacity: int, max_nodes: int = MAX_NODES) -> tuple[list[Pattern], int]:
    """Bins for a histogram of lengths, none above capacity; and a bound that no packing goes below.

    Branch and bound by bin completion: at a node the largest piece left gets a bin, completed by each of its undominated fillings,
    least waste first, in as many bins at once as pieces allow (then in one, when the search comes back). A branch ends when
    its waste so far makes as many bins as the best known packing; what is left is also packed by best fit, whose result becomes the best known
    if it is better. It ends at the bound, when all is searched, or after max_nodes; fillings are made as the search comes to them.
    """
    counts = {x: n for x, n in counts.items() if n > 0}
    if not counts:
        return [], 0
    bound = lower_bound(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    nodes = 0

    def branches(left: dict[int, int], made: list[Pattern], used: int, wasted: int, allowed: int) -> Iterator[tuple[dict[int, int], list[Pattern], int, int] | None]:
        largest = max(left)
        others = {**left, largest: left[largest] - 1}
        lengths = sorted((x for x, n in others.items() if n and x <= capacity - largest), reverse=True)
        for filling in completions(others, lengths, capacity - largest, allowed):
            if filling is None:
                yield None
                continue
            bin_ = (largest, *filling)
            uses = {x: bin_.count(x) for x in bin_}
            most = min(left[x] // n for x, n in uses.items())
            waste = capacity - sum(bin_)
            for times in dict.fromkeys((most, 1)):
                if waste * times > allowed:
                    times = 1
                after = {x: n - uses.get(x, 0) * times for x, n in left.items()}
                yield {x: n for x, n in after.items() if n}, made + [(bin_, times)], used + times, wasted + waste * times

    stack: list[Iterator] = [iter([(counts, [], 0, 0)])]
    while stack and size > bound and nodes < max_nodes:
        branch = next(stack[-1], stack)
        if branch is stack:
            stack.pop()
            continue
        nodes += 1
        if branch is None:
            continue
        left, made, used, wasted = branch
        if not left:
            if used < size:
                best, size = made, used
            continue
        # bins of a better packing waste at most this in all
        allowed = (size - 1) * capacity - total - wasted
        if allowed < 0 or used + lower_bound(left, capacity) >= size:
            continue
        rest = best_fit(left, capacity)
        if used + sum(n for _, n in rest) < size:
            best, size = made + rest, used + sum(n for _, n in rest)
            if size <= bound:
                break
        stack.append(branches(left, made, used, wasted, allowed))
    return best, bound


def _search(capacity: int, max_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for b in batches:
            counts |= dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if not counts:
            return
        patterns, bound = pack(counts, capacity, max_nodes)
        # places of each length: pieces ranked first .. first + bins * each - 1 fill these bins
        place: dict[int, int] = {}
        rows, bin_ = [], 0
        for lengths, n in patterns:
            for x in dict.fromkeys(lengths):
                k = lengths.count(x)
                rows.append((x, place.get(x, 0), bin_, k, capacity - sum(lengths)))
                place[x] = place.get(x, 0) + n * k
            bin_ += n
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] + [pa.array([v] * len(rows), pa.int64()) for v in (bin_, bound)]
        yield pa.RecordBatch.from_arrays(columns, ["length", "first", "bin", "each", "room", "n_bins", "min_bins"])

    return run


def _numbered(capacity: int):
    """Each document with what it needs to be placed without a sort: its part, the full pieces before it there, and the rests of its rest's length before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, full, seen = TaskContext.get().partitionId(), 0, np.zeros(capacity, np.int64)
        for b in batches:
            words = b.column(1).to_numpy().astype(np.int64)
            rest, whole = words % capacity, words // capacity
            order = np.argsort(rest, kind="stable")
            r = rest[order]
            start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, np.int64)
            size = np.diff(np.concatenate([start, [len(r)]]))
            rank = np.empty(len(r), np.int64)
            rank[order] = np.arange(len(r)) - np.repeat(start, size) + seen[r]
            seen[r[start]] += size
            before = full + np.cumsum(whole) - whole
            full += int(whole.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), part, np.int32)), b.column(0), pa.array(words), pa.array(before), pa.array(rank)], ["part", "doc_id", "words", "full", "rests"])

    return run


def _assign(capacity: int, shared):
    """The bin of each piece, from its rank among those of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, n_bins, min_bins, n_full = shared.value
        key = places[:, 0] << 40 | places[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            whole = length == capacity
            bin_, room = n_bins + rank, np.zeros(len(rank), np.int32)
            at = at[~whole]
            bin_[~whole] = places[at, 2] + (rank[~whole] - places[at, 1]) // places[at, 3]
            room[~whole] = places[at, 4]
            total = [pa.array(np.full(len(rank), n + n_full, np.int64)) for n in (n_bins, min_bins)]
            yield pa.RecordBatch.from_arrays([pa.array(bin_), *[b.column(k) for k in range(4)], pa.array(room), *total], ["bin", "doc_id", "piece", "start", "length", "room", "n_bins", "min_bins"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row (bin, doc_id, piece, start, length, room, n_bins, min_bins) for each piece: where in which training sequence it goes. room is what its bin leaves free.

    Lengths are words, separated by ASCII white space. A document longer than capacity is cut into pieces of capacity words and a rest; start is
    a piece's first word. Full pieces are bins by themselves. All rests are packed together by bin completion, over the histogram of their
    lengths: fewer than capacity numbers, so the search is one task whose size doesn't depend on the documents' number. Its bins are patterns
    with multiplicities, bounded likewise and broadcast; pieces of a length take that length's places in the order in which they are read. Each part of the
    table numbers its pieces by itself, and counts by (part, length) say where it begins: nothing is sorted, and a length that all documents have is no hot group.

    Packing is NP-hard: it is optimal if n_bins, all bins, is min_bins, below which no packing goes; else it is the best found in max_nodes nodes, never worse
    than best-fit decreasing. Texts without words and null texts have no piece. Ids may be null, and have to be of a whole-number type (else a TypeError);
    repeated rows are pieces of their own. Which of the pieces of a length goes where is a tie that reading order decides. An empty table gives no rows; other columns are not read.
    """
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))
    words = docs.select(doc_id(docs, id_col).alias("doc_id"), n_words.alias("words")).where("words > 0")
    d = written(words.transform(worker, _numbered(capacity), "part int, doc_id long, words long, full long, rests long"))
    pieces = d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("words") / capacity).cast("int") - 1)))
    start = F.col("piece").cast("long") * capacity
    length = F.least(F.lit(capacity), F.col("words") - start).cast("int")
    pieces = pieces.select("part", "doc_id", "piece", start.cast("int").alias("start"), length.alias("length"), F.when(length == capacity, F.col("full") + F.col("piece")).otherwise(F.col("rests")).alias("k"))
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    every = counts.groupBy("length").agg(F.sum("n").alias("n"))
    found = written(every.where(F.col("length") < capacity).coalesce(1).transform(worker, _search(capacity, max_nodes), "length long, first long, bin long, each long, room long, n_bins long, min_bins long"))
    rows = sorted(tuple(r) for r in found.collect())  # patterns, of which there are a few times capacity at most
    n_bins, min_bins = rows[0][5:] if rows else (0, 0)
    n_full = every.where(F.col("length") == capacity).agg(F.sum("n")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast((np.array([r[:5] for r in rows], np.int64).reshape(-1, 5), n_bins, min_bins, n_full))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select(F.col("part").alias("__part"), F.col("length").alias("__length"), before.alias("before")))
    ranked = join_small(pieces, offsets, (F.col("part") == F.col("__part")) & (F.col("length") == F.col("__length")), "inner")
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("k") + F.col("before")).alias("rank"))
    return ranked.transform(worker, _assign(capacity, shared), "bin long, doc_id long, piece int, start int, length int, room int, n_bins long, min_bins long")
