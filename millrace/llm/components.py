"""Connected components by alternate large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import Table


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but for the roots themselves; root is the least node of the component.

    A large star ties each node's larger neighbours to the least it knows, a small star its smaller ones; after
    O(log^2) rounds only stars are left. Loops and repeated edges don't matter; edges with a null are dropped.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    table = Table(e)
    known = _summary(table.read())
    while known[0]:
        e = table.read()
        least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("m", least)
        large = both.where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select("m", F.explode(F.array("a", "b")).alias("a")).where("a <> m").select("a", F.col("m").alias("b")).distinct()
        after = Table(small)
        table.drop()
        table, last, known = after, known, _summary(after.read())
        if known == last:
            break
    return table.read().select(F.col("a").alias("node"), F.col("b").alias("root"))
