"""run() against plain Python, stage by stage and row by row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from test_quality_lm import brute_force

import corpus_pipeline
from millrace.llm import packing, quality_lm, simhash, substring

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents() -> list[tuple]:
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}" for a in ("ban", "kor", "lu", "mi", "sta", "te") for b in ("der", "fen", "go", "ne", "ril", "so", "tum")]
    vocabulary = [f"{a}{b}" for a in vocabulary for b in vocabulary]
    prose = lambda n: " ".join(rng.choice(vocabulary, n).tolist())
    shared, passage = prose(9), prose(60)
    docs = []
    for i in range(44):
        body = [prose(int(rng.integers(8, 40))) for _ in range(4)]
        if i % 5 == 1:
            body[1] = shared + "\t"
        if i % 7 == 2:
            body[2] = prose(3) + " " + passage + " " + prose(4)
        docs.append("\n".join(body))
    docs += [docs[3], docs[4] + " end", docs[5].replace("ban", "bon", 1), "", "  \n", None]
    docs += ["\n".join(f"{x} {vocabulary[k + j]}" for j, x in enumerate(docs[k].split("\n"))) for k in range(5, 15)]  # near copies of which no line is the same
    docs += ["".join(chr(int(x)) for x in rng.integers(33, 126, 300)) for _ in range(4)]
    return [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(docs)]


def _quality(docs, labels, roles):
    """Texts of which the model's perplexity is above the language's limit go, and those without bytes."""
    fitted = [d[1] for d in docs if roles.get(d[0]) == 1]
    ppl = {d[0]: brute_force(fitted, d[1]) for d in docs if d[1]}
    most = {}
    for lang in ("de", "en"):
        judges = [d for d in docs if roles.get(d[0]) == 2 and d[0] in ppl]
        steps = sorted(math.ceil(ppl[d[0]] * quality_lm.GRID) for d in [d for d in judges if d[2] == lang] or judges)
        most[lang] = next(s for k, s in enumerate(steps, 1) if k >= quality_lm.HIGH * len(steps)) / quality_lm.GRID
    return [d for d in docs if d[0] in ppl and ppl[d[0]] <= most[d[2]]]


def _lines(docs):
    seen, out = set(), []
    for d in docs:
        kept = []
        for line in d[1].split("\n"):
            key = line.strip(" \t\r")
            if not key or key not in seen:
                kept.append(line)
            seen.add(key)
        text = "\n".join(kept)
        if text.strip():
            out.append((d[0], text, *d[2:]))
    return out


def _near(docs):
    f1, f2, n = simhash.simhash(pa.array([d[1] for d in docs]))
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if n[i] and n[j] and bin(int(f1[i]) ^ int(f1[j])).count("1") + bin(int(f2[i]) ^ int(f2[j])).count("1") <= simhash.RADIUS:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [d for i, d in enumerate(docs) if root[i] == i]


def _substrings(docs, size=substring.MIN_WORDS):
    first, out = {}, []
    for d in docs:
        words = d[1].split()
        gone = set()
        for p in range(len(words) - size + 1):
            if first.setdefault(tuple(words[p : p + size]), (d[0], p)) != (d[0], p):
                gone |= set(range(p, p + size))
        text = substring.cut_spans(d[1], [(p, 1) for p in sorted(gone)])
        assert text.split() == [w for i, w in enumerate(words) if i not in gone]
        if text.strip():
            out.append((d[0], text, *d[2:]))
    return out


def test_stages_and_run_are_those_of_brute_force(spark, tmp_path):
    rows = _documents()
    labels = [(i, 1, 0) for i in range(44) if i % 3 != 1] + [(r[0], 0, 0) for r in rows[-4:]]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled.write.parquet(str(tmp_path / "labels.parquet"))
    roles = {r["__mr_doc"]: r["__mr_role"] for r in quality_lm.trusted(labelled).collect()}
    assert {roles.get(i) for i in range(44)} == {1, 2, None}

    want = rows
    got = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, brute in enumerate((lambda d: _quality(d, labels, roles), _lines, _near, _substrings)):
        want, before = brute(want), want
        got = spark.createDataFrame(corpus_pipeline.STAGES[k][1](spark, got, str(tmp_path)).collect(), COLUMNS)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert want != before, k

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = sorted((r.doc_id, r.piece, r.start, r.length) for r in packed)
    assert pieces == [(d[0], i, i * packing.CAPACITY, min(packing.CAPACITY, len(d[1].split()) - i * packing.CAPACITY)) for d in want for i in range(-(-len(d[1].split()) // packing.CAPACITY))]
    bins: dict = {}
    for r in packed:
        bins.setdefault(r.bin, []).append(r)
    total = sum(len(d[1].split()) for d in want)
    assert all(sum(r.length for r in b) + b[0].room == packing.CAPACITY for b in bins.values()) and len(bins) == packed[0].n_bins == -(-total // packing.CAPACITY)
