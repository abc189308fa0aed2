from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from millrace.llm import quality_lm as q

DATA = "/root/testdata/sf0.01"


def brute_force(training: list[str], text: str) -> float:
    """Bits a byte, by the textbook recursion over dictionaries of counts."""
    pad = b"\0" * (q.ORDER - 1)
    counts = {q.ORDER: Counter()}
    for t in training:
        raw = pad + t.encode()
        counts[q.ORDER].update(raw[i - q.ORDER + 1 : i + 1] for i in range(q.ORDER - 1, len(raw)))
    for n in range(q.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: q.discounts(np.array([sum(c == k for c in counts[n].values()) for k in range(1, 5)])) for n in counts}
    follow = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            follow[n][g[:-1]].append(k)

    def p(gram: bytes) -> float:
        n = len(gram)
        lower = p(gram[1:]) if n > 1 else 1 / 256
        have = follow[n].get(gram[:-1])
        if not have:
            return lower
        k = counts[n].get(gram, 0)
        return (k - d[n][min(k, 3)] + sum(d[n][min(x, 3)] for x in have) * lower) / sum(have)

    raw = pad + text.encode()
    return -sum(math.log2(p(raw[i - q.ORDER + 1 : i + 1])) for i in range(q.ORDER - 1, len(raw))) / len(text.encode())


def test_perplexity_is_that_of_the_textbook(spark):
    training = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog and a mouse", "der Hund saß auf der Matte", "x"]
    texts = [*training, "the cat ate the dog", "zzz qqq", "ß", "the the the the the"]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang="en") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([Row(doc_id=i, quality=1, toxic=0) for i in range(len(training))])
    role = {r["__mr_doc"]: r["__mr_role"] for r in q.trusted(labels).collect()}
    fitted = [t for i, t in enumerate(training) if role[i] == 1]
    assert fitted
    got = {r.doc_id: r.log2_ppl for r in q.perplexities(docs, labels).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_force(fitted, t), abs=1e-5), t


@pytest.mark.parametrize("n", [(10145, 2614, 2832, 1839), (1, 1, 1, 1), (5, 0, 0, 0), (1, 100, 1, 1), (1, 1, 100, 1), (1, 1, 1, 100), (0, 0, 0, 0)])
def test_discounts_leave_something_for_the_unseen(n):
    d = q.discounts(np.array(n))
    assert d[0] == 0 and (d[1:] > 0).all() and (d <= [0, 1, 2, 3]).all()


def test_held_out_accuracy(spark):
    """Labelled documents that aren't trained on: most bad ones are rejected, good ones hardly ever."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    role = {r["__mr_doc"]: r["__mr_role"] for r in q.trusted(labels).collect()}
    label = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    bad, good = [], []
    for r in q.classify(docs, labels).collect():
        if r.doc_id in label and role.get(r.doc_id) != 1:
            if label[r.doc_id][0] == 0:
                bad.append(r.rejected)
            elif label[r.doc_id] == (1, 0):
                good.append(r.rejected)
    assert np.mean(bad) > 0.7 and np.mean(good) < 0.05


def test_nulls_empty_texts_repeats_and_clashing_names(spark):
    good = "plain words in a plain order, as people write them. "
    rows = [(i, good * 3, "en", i) for i in range(60)] + [(None, good * 3, None, 1), (100, None, "en", 2), (101, "", "en", 3), (102, "\x01\x02\x03\x04" * 50, "en", 4), (102, "\x01\x02\x03\x04" * 50, "en", 4), (103, good * 50_000, "xx", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 1, 0), (7, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].rejected and by[101].rejected and by[100].perplexity is None
    assert by[102].rejected and not by[103].rejected and not by[0].rejected
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 103 in ids and not {100, 101, 102} & set(ids)


def test_without_trusted_documents_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text", "en"), (2, "", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.rejected for r in q.classify(docs, none).collect()} == {1: False, 2: True, 3: True}
    assert q.classify(docs.limit(0), none).count() == 0
    assert [r.doc_id for r in q.keep_good(docs, none).collect()] == [1]


def test_packs_cut_nothing(monkeypatch):
    """A long text in several segments has all its n-grams, each once in its place."""
    monkeypatch.setattr(q, "_SEGMENT", 7)
    padded, at = q._padded(pa.array(["abcdefghijklmnopqrstuvwxyz", "", "xy"]))
    assert sum(len(k) for k, _ in q._segments(padded, at)) == 28
