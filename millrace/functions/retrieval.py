"""Exact vector search, BM25, and their fusion by reciprocal rank: plans of built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

K1, B, K0 = 1.2, 0.75, 60


def cosine_distance(vec: str, query: list[float]) -> Column:
    """1 - cosine; 1 where a vector is zero. A vector of another length than the query's has no distance."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = F.transform(vec, lambda x: x.cast("double"))
    dot, size = total(F.zip_with(v, q, lambda x, y: x * y)), F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.when(F.size(vec) == len(query), F.when((size > 0) & F.lit(norm > 0), F.lit(1.0) - dot / (size * F.lit(norm))).otherwise(1.0))


def nearest(rows: DataFrame, key: str, vec: str, query: list[float], k: int) -> DataFrame:
    """(key, distance, rank) of the k nearest rows, ties by key. A top-k over partial top-ks: no full sort, nothing but k rows moves."""
    best = rows.where(F.col(vec).isNotNull()).select(key, F.round(cosine_distance(vec, query), 12).alias("distance")).where("distance IS NOT NULL").orderBy("distance", key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))  # of k rows


def term_counts(rows: DataFrame, key: str, tok: str, terms: list[str]) -> DataFrame:
    """(key, dl, tf0, tf1, ...): each row's tokens and how often each term is among them. A row's array is taken apart once, however many terms there are."""
    each = rows.select(key, F.explode(tok).alias("__term"))
    return each.groupBy(key).agg(F.count("*").alias("dl"), *[F.count_if(F.col("__term") == t).alias(f"tf{i}") for i, t in enumerate(terms)])


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def _gain(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def best_matches(rows: DataFrame, corpus: DataFrame, key: str, tok: str, terms: list[str], k: int) -> DataFrame:
    """(key, score, rank) of the k rows of highest BM25, ties by key; rows without any of the terms have none. Statistics are of all rows of corpus that have tokens."""
    terms = list(dict.fromkeys(terms))
    counts = term_counts(corpus, key, tok, terms)
    stats = counts.agg(F.count("*").alias("__n"), F.avg("dl").alias("__avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
    score, found = F.lit(0.0), F.lit(False)
    for i in range(len(terms)):
        score += _idf(F.col("__n"), F.col(f"__df{i}")) * _gain(F.col(f"tf{i}"), F.col("dl"), F.col("__avg"))
        found |= F.col(f"tf{i}") > 0
    own = counts if rows is corpus else term_counts(rows, key, tok, terms)
    best = own.where(found).crossJoin(F.broadcast(stats)).select(key, F.round(score, 12).alias("score")).orderBy(F.desc("score"), key).limit(k)  # stats are one row
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def best_postings(found: tuple[DataFrame, DataFrame, DataFrame], window: Column, key: str, terms: list[str], k: int) -> DataFrame:
    """What best_matches gives, from postings: only those of the terms are read, and only their rows' tombstones looked up. Statistics are of all rows, deleted ones too."""
    post, stat, tombs = found
    terms = list(dict.fromkeys(terms))
    mine = post.where(F.col("term").isin(terms))
    df = mine.groupBy(F.col("term").alias("__term")).agg(F.count("*").alias("__df"))
    total = stat.agg(F.sum("n").alias("__n"), (F.sum("total") / F.sum("n")).alias("__avg"))
    gone = tombs.groupBy(F.col("_deleted").alias("__gone")).agg(F.min("deleted_ds").alias("deleted_ds"))
    seen = mine.join(gone, F.col("key").cast("string") == F.col("__gone"), "left").where(window)
    part = _idf(F.col("__n"), F.col("__df")) * _gain(F.col("tf"), F.col("dl"), F.col("__avg"))
    scored = seen.join(F.broadcast(df), F.col("term") == F.col("__term")).crossJoin(F.broadcast(total)).groupBy(F.col("key").alias(key)).agg(F.round(F.sum(part), 12).alias("score"))  # a row a term, and one row
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """(key, _score): the k best by 1/(60 + rank), summed over the two rankings."""
    both = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full_outer")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(K0)) + F.col(r)), F.lit(0.0))
    return both.select(key, (part("ra") + part("rb")).alias("_score")).orderBy(F.desc("_score"), key).limit(k)


def search_table(physical: DataFrame, window: Column, key: str, show: list[str], tok: str, vec: str, terms: list[str], query: list[float], k: int, candidates: int, postings: tuple | None = None) -> DataFrame:
    """Rows of the window with _score, k at most. Candidates are of the window before they are ranked; corpus statistics are of all rows, deleted ones too."""
    seen = physical.where(window)
    words = best_postings(postings, window, key, terms, candidates) if postings else best_matches(seen, physical, key, tok, terms, candidates)
    hits = fuse(nearest(seen, key, vec, query, candidates), words, key, k)
    return seen.select(*show).join(F.broadcast(hits), key).select(*show, "_score")  # at most k rows are broadcast
