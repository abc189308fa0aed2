"""License scans: matching statistics of texts against a suffix automaton of licence tokens."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import doc_id, pieces, words, worker
from .license_texts import TEMPLATES

MIN_MATCH = 3
#: Text tokens that may lie between two matches of a chain, and the part of a template that a span has to cover.
MAX_GAP, MIN_COVERAGE = 20, 0.6
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”‘’«»–—"


def token(word: str) -> str:
    """A lower-case word without punctuation at its ends; a word of punctuation only stays."""
    return word.strip(_EDGE) or word


class Automaton:
    """A generalised suffix automaton of token sequences: its states stand for their substrings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        self._ends = ends
        for k, sequence in enumerate(sequences):
            last = 0
            for i, t in enumerate(sequence):
                last = self._extend(last, t)
                ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            ends[self.link[v]] |= ends[v]  # a suffix ends wherever the whole does
        ends[0] = set()
        self.ends = [sorted(e) for e in ends]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self._ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:  # from an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """For each token the length of the longest match that ends with it, and its state."""
        out, v, n = [], 0, 0
        for t in tokens:
            while v and t not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if t in self.next[v]:
                v, n = self.next[v][t], n + 1
            out.append((n, v))
        return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        self.vocabulary: dict[str, int] = {}
        self.sequences = [[self.vocabulary.setdefault(token(w), len(self.vocabulary)) for w in text.lower().split()] for _, text in templates]
        self.automaton = Automaton(self.sequences)
        base = len(self.vocabulary)
        self.grams = np.unique(np.array([(s[i] * base + s[i + 1]) * base + s[i + 2] for s in self.sequences for i in range(len(s) - 2)], np.int64))

    def runs(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first token, end) of runs of known tokens in which MIN_MATCH tokens in a row match: no match lies elsewhere."""
        known = ids >= 0
        edge = np.zeros(len(ids) + 1, bool)
        edge[offsets] = True
        base = len(self.vocabulary)
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:] & ~edge[1:-2] & ~edge[2:-1]) if len(ids) > 2 else np.empty(0, np.int64)
        gram = (ids[at] * base + ids[at + 1]) * base + ids[at + 2]
        at = at[self.grams[np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)] == gram]
        end = -1
        for i in at.tolist():
            if i < end:
                continue
            start = i
            while not edge[start] and known[start - 1]:
                start -= 1
            end = i + 1
            while end < len(ids) and known[end] and not edge[end]:
                end += 1
            yield int(np.searchsorted(offsets, start, side="right")) - 1, start, end

    def matches(self, ids: list[int], start: int) -> list[tuple[int, int, int, int]]:
        """(template, its position, text position, length) of the matches of at least MIN_MATCH tokens that can't be longer at their ends."""
        found = []
        stats = self.automaton.statistics(ids)
        for i, (n, v) in enumerate(stats):
            if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][0] <= n):
                found += [(k, e - n, start + i + 1 - n, n) for k, e in self.automaton.ends[v]]
        return found

    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(start, end, template, covered tokens) of the best spans of one text that don't overlap, in order."""
        by: dict[int, list] = {}
        for k, a, i, n in matches:
            by.setdefault(k, []).append((i, a, n))
        found = [(*span[:2], k, span[2]) for k, chunks in by.items() for span in chains(sorted(chunks), MIN_COVERAGE * len(self.sequences[k]))]
        kept: list = []
        for s in sorted(found, key=lambda s: (-s[3], -s[3] / len(self.sequences[s[2]]), s[0], s[2])):
            at = bisect.bisect_left(kept, s[:2])
            if (not at or kept[at - 1][1] <= s[0]) and (at == len(kept) or kept[at][0] >= s[1]):
                kept.insert(at, s)
        return kept


def chains(chunks: list[tuple[int, int, int]], least: float) -> Iterator[tuple[int, int, int]]:
    """(start, end, covered) of the chains that cover at least so many of a template's tokens: the best, then the best of what lies clear of it, and so on.

    chunks are (text position, template position, length), sorted. As matches can't be longer at their ends, those that begin later end later, and a chunk's
    predecessors, which end at most MAX_GAP before it, are the chunks just before it. When a chain is taken, only those to its right whose
    predecessors have changed are computed again. So the work is in proportion to the chunks, times those within MAX_GAP of one.
    """
    size = len(chunks)
    starts, ends = [c[0] for c in chunks], [c[0] + c[2] for c in chunks]
    best, back, alive = [0] * size, [-1] * size, [True] * size
    heap: list[tuple[int, int]] = []

    def compute(y: int) -> bool:
        i, a, n = chunks[y]
        top, before = n, -1
        for x in range(y - 1, bisect.bisect_left(ends, i - MAX_GAP) - 1, -1):
            j, b, m = chunks[x]
            if alive[x] and b < a and j < i:
                gain = n - max(0, j + m - i, b + m - a)
                if gain > 0 and best[x] + gain > top:
                    top, before = best[x] + gain, x
        changed = top != best[y] or before != back[y]
        best[y], back[y] = top, before
        if changed and top >= least:
            heapq.heappush(heap, (-top, y))
        return changed

    for y in range(size):
        compute(y)
    while heap:
        covered, top = heapq.heappop(heap)
        if not alive[top] or best[top] != -covered:
            continue
        first = top
        while back[first] >= 0:
            first = back[first]
        start, end = starts[first], ends[top]
        yield start, end, -covered
        x, reach = bisect.bisect_right(ends, start), end
        while x < size and starts[x] < end:
            alive[x] = False
            reach = max(reach, ends[x])
            x += 1
        while x < size and starts[x] <= reach + MAX_GAP:
            if compute(x):
                reach = max(reach, ends[x])
            x += 1


@lru_cache(2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def _scan(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(templates)
        for b in pieces(batches):
            codes, distinct, off = words(b.column(1), lower=True)
            known = np.fromiter((s.vocabulary.get(token(w), -1) for w in distinct), np.int64, len(distinct))
            ids = known[codes] if len(codes) else np.empty(0, np.int64)
            by: dict[int, list] = {}
            for doc, start, end in s.runs(ids, off):
                by.setdefault(doc, []).extend(s.matches(ids[start:end].tolist(), start - int(off[doc])))
            rows = [(doc, *span) for doc, m in by.items() for span in s.spans(m)]
            if rows:
                doc, start, end, k, n = zip(*rows)
                size = [len(s.sequences[x]) for x in k]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), pa.array([s.names[x] for x in k]), pa.array(k, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(n, pa.int32()), pa.array([x / y for x, y in zip(n, size)], pa.float64())],
                    ["doc_id", "license", "template", "start_token", "end_token", "covered_tokens", "coverage"],
                )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row (doc_id, license, template, start_token, end_token, covered_tokens, coverage) for each span of a text that covers a template.

    Tokens are words, separated by ASCII white space, lower-case, without punctuation at their ends. Of each whole text the runs of tokens
    that templates have, if MIN_MATCH of them in a row are in one, are streamed through the generalised suffix automaton of all templates (there is no match
    elsewhere); the matching statistics give the matches of at least MIN_MATCH tokens. For each
    template matches in its order, at most MAX_GAP text tokens apart, are chained for the most covered tokens. Chains that cover MIN_COVERAGE of
    the template are spans; where spans overlap the one with more covered tokens stays, then that of higher coverage, then the earlier, then the earlier template.

    A template of fewer than MIN_MATCH tokens is a ValueError. Null and empty texts have no spans. Repeated rows each give theirs; ids may be null, and have to
    be of a whole-number type (else a TypeError). Without rows or spans the result is empty. No shuffle: the automaton, of fixed size, is built once a worker.
    """
    fixed = tuple((str(n), str(t)) for n, t in templates)
    for n, t in fixed:
        if len(t.split()) < MIN_MATCH:
            raise ValueError(f"a template of {n} has fewer than {MIN_MATCH} tokens: {t!r}")
    return docs.select(doc_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(worker, 
        _scan(fixed), "doc_id long, license string, template int, start_token int, end_token int, covered_tokens int, coverage double"
    )
