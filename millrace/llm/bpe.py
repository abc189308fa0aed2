"""BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import doc_id, pieces, ragged, worker

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is split before the merges, for Java's regular expressions; \\s stands for Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
_NONE = np.int32((1 << 31) - 1)
_SLICE = 2 << 20  # bytes of text whose pairs are indexed together: an index of a whole partition would grow with it


class Vocabulary:
    """Tokens by rank; a pair's rank is that of the bytes it joins to."""

    def __init__(self, tokens: tuple[tuple[bytes, int], ...]):
        self.ranks = dict(tokens)
        self.bytes_ = {i: t for t, i in self.ranks.items()}
        size = max(self.bytes_) + 1
        whole = [self.bytes_.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(whole), np.uint8)
        self.length = np.array([len(t) for t in whole], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(self.ranks[t[:k]] << 32) | self.ranks[t[k:]]: i for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[p] for p in self.pair.tolist()], np.int32)
        # most lookups end here: a bit for each hash of a pair that can be merged
        self.sieve = np.zeros(1 << 24, bool)
        self.sieve[self._hash(self.pair)] = True

    @staticmethod
    def _hash(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)

    @staticmethod
    def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def rank(self, key: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE for those that don't merge."""
        out = np.full(len(key), _NONE)
        may = np.flatnonzero(self.sieve[self._hash(key)])
        at = np.minimum(np.searchsorted(self.pair, key[may]), len(self.pair) - 1)
        hit = self.pair[at] == key[may]
        out[may[hit]] = self.pair_rank[at[hit]]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """One word by the rule itself: merge the first pair of least rank, again and again."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after the other, and each word's number of tokens.

        An index maps each pair that occurs to the positions of its left parts, in all words. Active ranks are applied in ascending order, the least to all positions of its
        pairs at once; pairs that this makes join their lists, so that a rank may become active. Positions whose pair has changed since are passed over.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        if not n:
            return sym, size
        # neighbours; n is none
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        last = (np.cumsum(size) - 1)[size > 0]
        first = (np.cumsum(size) - size)[size > 0]
        after[last], before[first] = n, n
        after[n], before[n] = n, n
        alive = np.ones(n, bool)
        rank = np.full(n + 1, _NONE)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.rank(self.pairs(sym[inner], sym[inner + 1]))
        index: dict[int, list[np.ndarray]] = {}
        active: dict[int, list[int]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            key = self.pairs(sym[at], sym[after[at]])
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(at)]])
            for i, j, pair, r in zip(bounds.tolist(), bounds[1:].tolist(), key[bounds[:-1]].tolist(), rank[at[bounds[:-1]]].tolist()):
                have = index.get(pair)
                if have is not None:
                    have.append(at[i:j])
                    continue
                index[pair] = [at[i:j]]
                if r in active:
                    active[r].append(pair)
                else:
                    active[r] = [pair]
                    heapq.heappush(heap, r)

        start = inner[rank[inner] < _NONE].astype(np.int32)
        if len(start):
            add(start)
        odd: list[np.ndarray] = []
        while heap:
            now = heapq.heappop(heap)
            lists = [at for pair in active.pop(now) for at in index.pop(pair)]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == now]
            if len(at) > 1 and (at[1:] == after[at[:-1]]).any():  # overlapping: from the left, each part once
                taken, end, chosen = -1, -1, []
                for i, j in zip(at.tolist(), after[at].tolist()):
                    if i != end:
                        chosen.append(i)
                        end = j
                at = np.array(chosen, np.int32)
            if not len(at):
                continue
            right = after[at]
            sym[at] = now
            alive[right] = False
            rank[right] = _NONE
            nxt = after[right]
            after[at] = nxt
            before[nxt] = at  # position n takes what it gets
            prev = before[at]
            a, p = at[nxt < n], at[prev < n]
            rank[at] = _NONE
            rank[a] = self.rank(self.pairs(sym[a], sym[after[a]]))
            rank[prev[prev < n]] = self.rank(self.pairs(sym[prev[prev < n]], sym[p]))
            rank[n] = _NONE
            fresh = np.concatenate([a, prev[prev < n]])
            fresh = fresh[rank[fresh] < _NONE]
            if len(fresh):
                if (rank[fresh] <= now).any():  # a lower rank than one just applied: these words go by the rule itself
                    odd.append(fresh[rank[fresh] <= now])
                add(fresh)
        word = np.repeat(np.arange(len(words)), size)
        count = np.bincount(word[alive], minlength=len(words))
        tokens = sym[alive]
        if odd:
            redo = np.unique(word[np.concatenate(odd)])
            each = np.split(tokens, np.cumsum(count)[:-1])
            for w in redo.tolist():
                each[w] = np.array(self.encode_word(words[w]), np.int32)
            tokens, count = np.concatenate(each), np.array([len(e) for e in each])
        return tokens, count

    def decode(self, tokens: np.ndarray) -> bytes:
        parts = (tokens[i : i + 100_000] for i in range(0, len(tokens), 100_000))
        return b"".join(self.flat[ragged(self.start[t], self.length[t])].tobytes() for t in parts)


@lru_cache(2)
def _vocabulary(tokens: tuple[tuple[bytes, int], ...]) -> Vocabulary:
    return Vocabulary(tokens)


def load(path: str = VOCABULARY) -> tuple[tuple[bytes, int], ...]:
    """(token, rank) of a file with a base64 token and its rank a line, read on the driver; of fixed size, so it goes out with the tasks."""
    with open(path, "rb") as f:
        return tuple((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f))


def _token_ids(v: Vocabulary, b: pa.RecordBatch) -> pa.Array:
    """Token ids of a slice's texts (column 1), whose pre-tokens have the lengths in column 2: these are read where they lie in the text."""
    text, sizes = b.column(1), b.column(2)
    offsets, data = text.buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + b.num_rows + 1].astype(np.int64)
    size = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    off = sizes.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    end = at[0] + np.concatenate([[0], np.cumsum(size)])
    if not (end[off] == at).all():
        raise ValueError("the pattern has to cover each text from end to end")
    coded = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(end.astype(np.int32)), data or pa.py_buffer(b"")]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    tokens, count = v.encode_words(coded.dictionary.to_pylist())
    start = np.cumsum(count) - count
    flat = tokens[ragged(start[code], count[code])]
    ends = np.concatenate([[0], np.cumsum(count[code])])[off]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()), mask=text.is_null() if text.null_count else None)


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for b in pieces(batches, limit=_SLICE):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _token_ids(v, b)], ["doc_id", "text", "token_ids"])

    return run


def _split(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    parts = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0))
    return docs.select(doc_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), F.transform(parts, F.octet_length).alias("sizes"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text, token_ids) for each row, in its partition: no shuffle.

    The JVM splits texts into pre-tokens, by a pattern that covers all of a text (else a ValueError); a Python worker encodes the distinct ones of a few megabytes of text at once, with
    Vocabulary.encode_words, and puts the texts' ids together from them. A null text has null ids, an empty one none. Repeated rows and null ids
    give a row each; ids of another than a whole-number type are a TypeError; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    return _split(docs, id_col, text_col, pattern).transform(worker, _encode(shared), "doc_id long, text string, token_ids array<int>")


def _texts(v: Vocabulary, ids: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all lists, one after the other, and where each begins and ends."""
    tokens = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.concatenate([[0], np.cumsum(v.length[tokens])])
    n = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    return v.decode(tokens), size[np.concatenate([[0], np.cumsum(n)])]


def _decode(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for b in batches:
            ids = b.column(b.schema.get_field_index("token_ids"))
            out = []
            step = 100
            for i in range(0, b.num_rows, step):
                part = ids.slice(i, step)
                raw, at = _texts(v, part)
                at = at.tolist()
                out += [None if null else raw[x:y].decode("utf-8", "replace") for x, y, null in zip(at, at[1:], part.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keep], pa.array(out, pa.string())], [*keep, "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded with a column decoded: the text of token_ids. Null ids give null; bytes that aren't UTF-8 become the replacement character; an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))
    kept = [c for c in encoded.columns if c != "decoded"]
    df = encoded.select(*kept)
    return df.transform(worker, _decode(shared, kept), T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def _round_trip(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for b in pieces(batches, limit=_SLICE):
            ids, text = _token_ids(v, b), b.column(1)
            raw, at = _texts(v, ids)
            offsets, data = text.buffers()[1:]
            to = np.frombuffer(offsets, np.int32)[text.offset : text.offset + b.num_rows + 1]
            own = memoryview(data or b"").cast("B")
            same = [raw[x:y] == own[i:j] for x, y, i, j in zip(at.tolist(), at[1:].tolist(), to.tolist(), to[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.compute.utf8_length(text), pa.compute.list_value_length(ids), ids, pa.array(same, pa.bool_())], ["doc_id", "n_chars", "n_tokens", "token_ids", "round_trip"]
            )

    return run


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row (doc_id, n_chars, n_tokens, token_ids, round_trip) for each row of docs: round_trip, whether decoding gives the text's bytes again, which null texts, of null counts and ids, do.

    As encode and decode do it, in one worker: texts go to Python once and don't come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    return _split(docs, id_col, text_col, pattern).transform(worker, _round_trip(shared), "doc_id long, n_chars int, n_tokens int, token_ids array<int>, round_trip boolean")
