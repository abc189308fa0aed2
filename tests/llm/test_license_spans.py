from __future__ import annotations

from millrace.llm import licenses

WORDS = [f"t{i}" for i in range(20)]
TEMPLATES = [("long", " ".join(WORDS)), ("short", " ".join([*WORDS[4:9], "s1", "s2"])), ("other", "o1 o2 o3 o4 o5 o6 o7 o8")]
FILL = [f"x{i}" for i in range(60)]
DOCS = [
    [*FILL[:5], *WORDS, *FILL[5:9]],
    [*WORDS[:8], *FILL[:6], *WORDS[8:]],
    [*WORDS[:8], *FILL[:40], *WORDS[8:]],
    [*WORDS[:6], *FILL[:2], *WORDS[7:15], "and", *WORDS[16:]],
    [*WORDS, *FILL[:25], *WORDS, "x", *"o1 o2 o3 o4 o5".split()],
    [*WORDS[4:9], "s1", "s2", *FILL[:3], *"o1 o2 o3 o4".split()],
    ["O1,", "(O2)", "o3", "o4;", "y", "o6", "o7", "O8."],
    WORDS[::-1], FILL, [],
]


def _chains(matches, gap):
    """Every chain: (start, end, covered tokens)."""
    def go(last, start, covered):
        yield start, last[0] + last[2], covered
        for m in matches:
            if m[0] > last[0] and m[1] > last[1] and m[0] - last[0] - last[2] <= gap:
                gain = m[2] - max(0, last[0] + last[2] - m[0], last[1] + last[2] - m[1])
                if gain > 0:
                    yield from go(m, start, covered + gain)

    for m in matches:
        yield from go(m, m[0], m[2])


def _spans(text, templates):
    """(start, end, template, covered) by trying all substrings and all chains."""
    longest = []
    for end in range(1, len(text) + 1):
        longest.append(max(n for n in range(end + 1) if not n or any(t[i : i + n] == text[end - n : end] for t in templates for i in range(len(t) - n + 1))))
    found = []
    for k, t in enumerate(templates):
        matches = []
        for end, n in enumerate(longest, 1):
            if n >= licenses.MIN_MATCH and (end == len(text) or longest[end] <= n):
                matches += [(end - n, i, n) for i in range(len(t) - n + 1) if t[i : i + n] == text[end - n : end]]
        while matches:
            best = max(c for _, _, c in _chains(matches, licenses.MAX_GAP))
            if best < licenses.MIN_COVERAGE * len(t):
                break
            start, end, _ = min((x for x in _chains(matches, licenses.MAX_GAP) if x[2] == best), key=lambda x: (x[1], x[0]))
            found.append((start, end, k, best))
            matches = [m for m in matches if m[0] >= end or m[0] + m[2] <= start]
    kept = []
    for s in sorted(found, key=lambda s: (-s[3], -s[3] / len(templates[s[2]]), s[0], s[2])):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in kept):
            kept.append(s)
    return sorted(kept)


def test_spans_are_those_of_brute_force(spark):
    docs = spark.createDataFrame([*((i, " ".join(d)) for i, d in enumerate(DOCS)), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r.start_token, r.end_token, r.template, r.license, r.covered_tokens, round(r.coverage, 9)) for r in licenses.scan_licenses(docs, templates=TEMPLATES).collect()]
    templates = [t.split() for _, t in TEMPLATES]
    want = [(i, *s[:3], TEMPLATES[s[2]][0], s[3], round(s[3] / len(templates[s[2]]), 9)) for i, d in enumerate(DOCS) for s in _spans([w.lower().strip(",();.") for w in d], templates)]
    assert sorted(got) == sorted(want) and len(want) >= 8 and {w[3] for w in want} == {0, 1, 2}
