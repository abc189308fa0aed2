from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import quality_lm as q

DATA = "/root/testdata/sf0.01"


def test_bound_is_of_training_only(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    role = {r["__mr_doc"]: r["__mr_role"] for r in q.trusted(labels, 50).collect()}
    every = {r["__mr_doc"]: r["__mr_role"] for r in q.trusted(labels).collect()}
    assert Counter(role.values()) == {1: 50, 2: 150} and set(every) == set(role)
    assert all(every[d] == 1 for d, r in role.items() if r == 1)


def test_scores_carry_the_roles(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = q.perplexities(docs.where("doc_id < 300"), labels, most=40)
    want = {r["__mr_doc"]: r["__mr_role"] for r in q.trusted(labels, 40).collect()}
    rows = scored.select("doc_id", "role").collect()
    assert len(rows) == docs.where("doc_id < 300").count()
    assert all(r.role == want.get(r.doc_id, 0) for r in rows) and {r.role for r in rows} == {0, 1, 2}
    n = scored.where("role = 2 AND log2_ppl IS NOT NULL").select("lang").distinct().count()
    assert q.limits(scored).count() == 1 + n


def test_limits_and_rejections_are_those_of_brute_force(spark):
    """The least step of the grid up to which 0.995 of a language's calibrating documents are; all of them decide for a language without any."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 7, "only here").otherwise(F.col("lang")))
    labels = labels.where("doc_id % 50 <> 7")
    scored = [r for r in q.perplexities(docs, labels).collect()]

    def limit(values):
        steps = sorted(math.ceil(x * q.GRID) for x in values)
        return next(s for i, s in enumerate(steps) if sum(x <= s for x in steps) >= q.HIGH * len(steps)) / q.GRID

    by = {lang: [r.log2_ppl for r in scored if r.role == 2 and r.log2_ppl is not None and r.lang == lang] for lang in {r.lang for r in scored}}
    every = limit([x for v in by.values() for x in v])
    most = {lang: limit(v) if v else every for lang, v in by.items()}
    assert not by["only here"] and len([v for v in by.values() if v]) == 4
    want = {r.doc_id: r.log2_ppl is None or r.log2_ppl > most[r.lang] for r in scored}
    got = {r.doc_id: r.rejected for r in q.classify(docs, labels).collect()}
    assert got == want and 0 < sum(want.values()) < len(want) / 2


def test_all_trusted_documents_train_or_calibrate(spark):
    """However many they are: more than a million train here."""
    labels = spark.range(1_500_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    n = {r["__mr_role"]: r["count"] for r in q.trusted(labels).groupBy("__mr_role").count().collect()}
    held_out = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(q.CALIBRATE)) == 0).count()
    assert n == {1: 1_500_000 - held_out, 2: held_out} and n[1] > 1_000_000


def test_ids_that_share_a_bit_are_not_trained_on(spark, monkeypatch):
    """With a bitmap of a single bit every document is taken for a training one until the ids are compared."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 200").unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    ids = q.trusted(labels).where("__mr_role = 1").select("__mr_doc")
    mine, texts = {r["__mr_doc"] for r in ids.collect()}, docs.select("doc_id", "text")
    maybe = [r.doc_id for r in q._maybe(texts, ids).collect()]
    assert mine & set(range(200)) <= set(maybe) and len(maybe) < 100
    want = sorted(map(str, q.perplexities(docs, labels).collect()))
    monkeypatch.setattr(q, "MAX_BITS", 1)
    assert len(q._maybe(texts, ids).collect()) == 200
    assert sorted(map(str, q.perplexities(docs, labels).collect())) == want
