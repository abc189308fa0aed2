"""Joins that Spark's SQL has no words for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, keep: list[str]) -> DataFrame:
    """left with the columns keep of the last row of right, by by, whose right_on isn't after left_on; nulls if there is none.

    One sort of the union by key and time, then a running last value: a shuffle of both sides by key, and no join. Rows of left with a null
    key or time find nothing. Of right's rows at the same time the one with the greatest kept values counts.
    """
    a = left.select(F.struct(*left.columns).alias("__row"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*keep).alias("x")).schema["x"].dataType).alias("__kept"))
    b = right.where(F.col(right_on).isNotNull()).select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(*keep).alias("__kept"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy("__t", "__side", "__kept").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__last", F.last("__kept", ignorenulls=True).over(w)).where("__side = 1")
    known = F.col("__t").isNotNull()
    for i in range(len(by)):
        known &= F.col(f"__k{i}").isNotNull()
    return found.select("__row.*", *[F.when(known, F.col("__last")[c]).alias(c) for c in keep])


def count_within(spans: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __n): how many pairs of a span (keys, __lo, __hi) and a point (__x) there are with __lo <= __x <= __hi, by the span's keys; keys without any are left out.

    No pair is made: a span has as many points as there are up to its end, less those before its begin. Begins, points and ends are sorted together over all partitions
    and the points counted along; each partition sends its count to those after it. Equal rows are added up before, so that no value is too large for a partition.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    event = lambda t, side, c: F.struct(F.col(t).alias("t"), F.lit(side).alias("side"), F.lit(c).cast("long").alias("c"))
    ends = spans.where("__lo <= __hi").select(*keys, F.explode(F.array(event("__lo", 0, -1), event("__hi", 2, 1))).alias("e"))
    middle = points.where("__x IS NOT NULL").select(*[F.lit(None).cast(spans.schema[k].dataType).alias(k) for k in keys], event("__x", 1, 1).alias("e"))
    each = ends.unionByName(middle).groupBy(*keys, F.col("e.t").alias("__t"), F.col("e.side").alias("__side")).agg(F.sum("e.c").alias("__c"))
    each = each.repartitionByRange(n, "__t", "__side", *keys).sortWithinPartitions("__t", "__side").select(*keys, "__side", "__c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, schema = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            side, c = b.column("__side").to_numpy(), b.column("__c").to_numpy()
            upto = before + np.cumsum(np.where(side == 1, c, 0))
            before = int(upto[-1])
            at = np.flatnonzero(side != 1)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at)) for k in keys], pa.array(np.full(len(at), own)), pa.array(c[at]), pa.array((c * upto)[at]), pa.array(np.zeros(len(at), np.int64))], [*keys, *numbers])
        later = np.arange(own + 1, n)
        if before and len(later):
            none = np.zeros(len(later), np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(later), schema.field(k).type) for k in keys], pa.array(later), pa.array(none), pa.array(none), pa.array(none + before)], [*keys, *numbers])

    numbers = ["__part", "__sign", "__own", "__before"]
    counted = each.mapInArrow(run, T.StructType([*[T.StructField(k, spans.schema[k].dataType) for k in keys], *[T.StructField(c, T.LongType()) for c in numbers]]))
    whole = counted.withColumn("__all", F.sum("__before").over(Window.partitionBy("__part"))).where("__sign != 0")
    return whole.groupBy(*keys).agg(F.sum(F.col("__own") + F.col("__sign") * F.col("__all")).alias("__n")).where("__n > 0")
