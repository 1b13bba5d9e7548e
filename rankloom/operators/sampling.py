"""Deterministic sampling. The order is that of an md5 of key and seed: it doesn't depend on partitions, is the same in
every engine, and a larger sample contains the smaller one."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task keeps only its own first n before rows move."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def pointwise_sample(df: DataFrame, problem: str, sid: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` candidates of each problem, without replacement; all of them for n = -1."""
    return df if n < 0 else first_per_group(df, [problem], [hash_order(seed, problem, sid), F.col(sid)], n)


def pairwise_sample(df: DataFrame, problem: str, sid: str, passed: str, n: int, seed: int) -> DataFrame:
    """Pairs of a passing and a failing candidate: per problem min(passing, failing, n), none used twice.

    Returns ``problem, rn, chosen, rejected`` (sids).
    """
    w = Window.partitionBy(problem, "__p").orderBy(hash_order(seed, problem, sid), F.col(sid))
    d = df.withColumn("__p", F.coalesce(F.col(passed), F.lit(False))).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return d.groupBy(problem, "rn").agg(F.max(F.when(F.col("__p"), F.col(sid))).alias("chosen"), F.max(F.when(~F.col("__p"), F.col(sid))).alias("rejected")).filter("chosen is not null and rejected is not null")


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement (a top-n by hash)."""
    return df.orderBy(hash_order(seed, key), F.col(key)).limit(n)


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement: rows with ``draw``. Every draw takes the row at a hashed place of the key's order.

    ``n`` is a setting; the drawn places are joined with numbered rows, so nothing is collected.
    """
    spark = df.sparkSession
    total = df.count()
    if not total:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    draws = spark.range(n).select(F.col("id").alias("draw"), F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id"), F.lit(str(seed)))), 1, 12), 16, 10).cast("bigint"), F.lit(total)).alias("__at"))
    return with_row_numbers(df, [key], "__at").join(draws, "__at").drop("__at")


def with_row_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of the columns, without bringing the rows to one task: rows are range
    partitioned and sorted, and each partition's numbers start after the rows of the partitions before."""
    d = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    d = d.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0).cast("bigint")).alias("__start"))
    return d.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__in")).drop("__part", "__in", "__start")


def head_and_tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n/2 and the last n/2 rows of an order."""
    a = df.orderBy(*[F.asc(c) for c in order]).limit(n - n // 2)
    b = df.orderBy(*[F.desc(c) for c in order]).limit(n // 2)
    return a.unionByName(b).dropDuplicates(list(order))


def longest(df: DataFrame, length: Column, key: str, n: int) -> DataFrame:
    """The ``n`` longest rows, at equal length by key."""
    return df.orderBy(length.desc(), F.col(key)).limit(n)


def validation_split(pool: DataFrame, key: str, pct: float, most: int, seed: int, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(validation, train): min(ceil(size * pct), most) rows of the pool by hash order; ``size`` is the pool's unless given."""
    n = min(math.ceil((size if size is not None else pool.count()) * pct), most)
    chosen = sample_rows(pool.select(key).distinct(), key, n, seed)
    return pool.join(chosen, key, "left_semi"), pool.join(chosen, key, "left_anti")
