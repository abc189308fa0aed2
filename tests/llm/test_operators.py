from __future__ import annotations

from collections import Counter

import oracle
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, chat, fingerprint, licenses, linededup, packing, quality_rules, queries, simhash, substring

SF = "/root/testdata/sf0.001"
GOOD = " ".join(f"word{i}" for i in range(120))
ODD = [(1, GOOD, "en", "a", 1), (1, GOOD, "en", "a", 1), (2, GOOD + "\n" + GOOD, None, None, None), (3, None, "en", "a", 2), (4, "", "en", "a", 3), (None, "a line\na line\n", "en", "", 4), (5, "  \n\t", "de", "b", 5), (6, "x " * 50_000, "en", "b", 6)]
SCHEMA = "doc_id long, text string, lang string, source string, keep int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    oracle.check(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, SF)


ONE_TABLE = {
    "bpe": bpe.encode_and_decode, "packing": packing.pack_documents, "lines": linededup.keep_bitmaps, "dedup_lines": linededup.dedup_lines, "prints": fingerprint.fingerprints, "near": simhash.near_groups,
    "dedup_near": simhash.dedup_near, "licenses": licenses.scan_licenses, "spans": substring.repeated_spans, "dedup_spans": substring.dedup_substrings, "rules": quality_rules.line_frequency_rules,
}


@pytest.mark.parametrize("name", ONE_TABLE)
def test_odd_rows_and_empty_tables(odd, name):
    """Nulls in every column, empty and long texts, repeated rows and a column whose name clashes; then no rows at all."""
    rows = ONE_TABLE[name](odd).collect()
    assert ONE_TABLE[name](odd.limit(0)).count() == 0
    if name == "bpe":
        assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    if name == "near":
        group = {r.doc_id: r.group_id for r in rows}
        assert group[1] == group[2] == 1 and group[3] == 3 and group[None] is None
    if name == "dedup_near":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "5", "6", "None"]
    if name == "dedup_lines":
        assert {r.doc_id: r.text for r in rows}[None] == "a line\n"
    if name == "dedup_spans":
        assert 2 not in {r.doc_id for r in rows}


def test_tokens_are_those_of_a_known_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    known = tiktoken.Encoding("t", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert r.token_ids == known.encode_ordinary(r.text)


def test_packing_is_whole_and_no_worse_than_best_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, capacity=256).collect()
    want = {r.doc_id: len(r.text.split()) for r in docs.select("doc_id", "text").collect()}
    got, bins = {}, {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin, []).append(r)
    assert got == {d: n for d, n in want.items() if n}
    assert all(sum(r.length for r in b) + b[0].room == 256 for b in bins.values())
    rests = Counter(n % 256 for n in want.values() if n % 256)
    best_fit = sum(n for _, n in packing.best_fit(dict(rests), 256)) + sum(n // 256 for n in want.values())
    assert rows[0].min_bins <= len(bins) == rows[0].n_bins <= best_fit


def _best(counts: list[int], room: int) -> int:
    """Fewest bins, by trying all."""
    def go(rest, bins):
        if not rest:
            return len(bins)
        out = 99
        for i, b in enumerate(bins):
            if b + rest[0] <= room and b not in bins[:i]:
                out = min(out, go(rest[1:], bins[:i] + (b + rest[0],) + bins[i + 1 :]))
        return min(out, go(rest[1:], (*bins, rest[0])))

    return go(tuple(sorted(counts, reverse=True)), ())


def test_packing_is_optimal_on_small_sets():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(1, 12, 8).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        patterns, bound = packing.pack(counts, 12)
        assert sum(n for _, n in patterns) == _best(lengths, 12) >= bound


def test_masks_cover_the_radius():
    masks, rng = simhash.covering_masks(), np.random.default_rng(2)
    for _ in range(2000):
        x = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 7, replace=False).astype(np.uint64))
        assert (masks & x == 0).any()


def test_near_groups_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = [r for r in simhash.prints(docs).collect() if r.n_words]
    f1, f2 = (np.array([r[c] for r in p], np.int64).view(np.uint64) for c in ("f1", "f2"))
    root = {r.doc_id: r.doc_id for r in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(p)):
        for j in np.flatnonzero(simhash.distances(f1[i], f2[i], f1[:i], f2[:i]) <= simhash.RADIUS).tolist():
            a, b = sorted((find(p[i].doc_id), find(p[j].doc_id)))
            root[b] = a
    got = {r.doc_id: r.group_id for r in simhash.near_groups(docs).collect()}
    assert {d: got[d] for d in root} == {d: find(d) for d in root}


def test_matching_statistics():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 4, n).tolist() for n in (1, 7, 20, 20)]
    automaton, text = licenses.Automaton(sequences), rng.integers(0, 5, 200).tolist()
    inside = lambda part: any(s[i : i + len(part)] == part for s in sequences for i in range(len(s)))
    for i, (n, v) in enumerate(automaton.statistics(text)):
        assert n == max(k for k in range(i + 2) if not k or inside(text[i + 1 - k : i + 1]))
        for k, end in automaton.ends[v]:
            assert sequences[k][end - n : end] == text[i + 1 - n : i + 1]


def test_a_whole_template_is_found(spark):
    name, text = max(licenses.TEMPLATES, key=lambda t: len(t[1]))
    docs = spark.createDataFrame([(1, "before it " + text + " and after"), (2, "nothing of the kind")], "doc_id long, text string")
    found = licenses.scan_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.start_token) for r in found] == [(1, name, 2)] and found[0].coverage == 1.0


def test_chat(spark):
    rows = [(None, 1, None, None), (1, None, "b", "late"), (1, 1, "system", "s"), (1, 2, "a", "x<|end|>"), (1, 2, "a", "x<|end|>"), (2, 1, "system", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.participant): r for r in chat.rotate_perspectives(turns).collect()}
    assert set(got) == {(None, "unknown"), (1, "a"), (1, "b")} and got[1, "a"].n_loss_turns == 2 and chat.rotate_perspectives(turns.limit(0)).count() == 0
    for r in got.values():
        for a, b in (map(int, x.split(":")) for x in r.loss_spans.split(";")):
            assert r.rendered[a:b].endswith("<|end|>")
    assert "x< |end|>" in got[1, "b"].rendered


def test_pipeline(spark):
    """Each stage keeps the columns of documents; what is packed are the words that the stages leave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, d, SF)
        assert after.columns == docs.columns
        rows = after.collect()
        assert 0 < len(rows) <= d.count()
        d = spark.createDataFrame(rows, docs.schema)
    left = {r.doc_id: len(r.text.split()) for r in d.collect()}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == left


def test_words_of_odd_texts():
    assert simhash.simhash(pa.array([None, "", "|"]))[2].tolist() == [0, 0, 1]
