from __future__ import annotations

from collections import Counter
from itertools import combinations_with_replacement

import numpy as np

from millrace.llm import packing


def _all(counts, room, waste):
    """Undominated fillings, by trying all."""
    found = []
    for n in range(room + 1):
        for c in combinations_with_replacement(sorted(counts, reverse=True), n):
            used, left = Counter(c), room - sum(c)
            spare = [x for x in counts if counts[x] > used[x]]
            if 0 <= left <= waste and all(used[x] <= counts[x] for x in used) and not any(y <= left or any(x < y <= x + left for x in c) for y in spare):
                found.append((left, [-x for x in c]))
    return [tuple(-x for x in c) for _, c in sorted(found)]


def test_fillings_are_all_there_are():
    rng = np.random.default_rng(4)
    for _ in range(150):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 9, 5)}
        room, waste = int(rng.integers(1, 12)), int(rng.integers(0, 5))
        lengths = sorted((x for x in counts if x <= room), reverse=True)
        got = list(packing.completions({x: counts[x] for x in lengths}, lengths, room, waste))
        assert got == _all({x: counts[x] for x in lengths}, room, waste)


def test_fillings_of_many_pieces_are_found():
    assert next(packing.completions({1: 2000}, [1], 1500, 0)) == (1,) * 1500


def test_no_cap_on_their_number():
    lengths = list(range(40, 0, -1))
    found = [f for f in packing.completions({x: 1 for x in lengths}, lengths, 60, 0) if f]
    assert len(found) == len(set(found)) > 1000 and all(sum(f) == 60 for f in found)
