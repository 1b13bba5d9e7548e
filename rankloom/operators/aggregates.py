"""Aggregates over problems and candidates that belong to no metric of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_counts(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def pass_level_counts(df: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Per key: candidates, and how many pass at each level."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"num_{c}") for c in levels])


def pair_statistics(df: DataFrame, keys: Sequence[str], passed: str) -> DataFrame:
    """Over problems: how many have passes and pairs (min of passing and failing), and mean and deviation of both."""
    p = F.coalesce(F.col(passed), F.lit(False))
    per = df.groupBy(*keys).agg(F.count_if(p).alias("passes"), F.count_if(~p).alias("fails")).withColumn("pairs", F.least("passes", "fails"))
    return per.agg(
        F.count(F.lit(1)).alias("problems"),
        *[x for c in ("passes", "pairs") for x in (F.avg((F.col(c) > 0).cast("double")).alias(f"with_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))],
    )


def problems_passing(df: DataFrame, keys: Sequence[str], levels: dict[str, Column]) -> DataFrame:
    """How many problems have at least one program that passes at each level."""
    per = df.groupBy(*keys).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in levels.items()])
    return per.agg(F.count(F.lit(1)).alias("problems"), *[F.count_if(n).alias(n) for n in levels])


def length_statistics(df: DataFrame, length: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(length).alias("total"), F.max(length).alias("longest"), F.avg(length).alias("mean"), F.stddev_pop(length).alias("std"))


def uniform_total(df: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """One row: the number of different totals of ``count`` over the groups, the least and the largest."""
    per = df.groupBy(*keys).agg(F.sum(F.coalesce(F.col(count), F.lit(1))).alias("t"))
    return per.agg(F.count_distinct("t").alias("totals"), F.min("t").alias("least"), F.max("t").alias("largest"))


def import_counts(df: DataFrame, imports: str, count: Column, passed: Column, least: int = 0) -> DataFrame:
    """Per imported package: programs and passing programs, weighted by ``count``."""
    d = df.select(F.explode(F.array_distinct(imports)).alias("package"), count.alias("c"), passed.alias("p"))
    return d.groupBy("package").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("p"), F.col("c")).otherwise(0)).alias("passes")).filter(F.col("n") >= least)


def percentile_columns(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[int] = (50, 90, 99)) -> DataFrame:
    """Per key exact percentiles, interpolated, as ``percentile_NN``; null and NaN are no values."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(*[F.percentile(v, p / 100).alias(f"percentile_{p:02d}") for p in at])


def passed_at(df: DataFrame, keys: Sequence[str], outcomes: Column, n: int) -> DataFrame:
    """Per key whether all rows pass their first ``n`` tests."""
    return df.groupBy(*keys).agg(F.bool_and(F.forall(F.slice(outcomes, 1, n), lambda x: x)).alias(f"passed_at_{n}"))


def validation_metrics(per_task: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The mean of each metric over tasks."""
    return per_task.agg(*[F.avg(m).alias(m) for m in metrics])


def throughput(totals: DataFrame, stages: Sequence[str], total: str = "total_programs") -> DataFrame:
    """Programs per second of each stage that took time, and of filtering and scoring together."""
    per = [F.when(F.col(s) > 0, F.col(total) / F.col(s)).alias(f"{s}_pps") for s in stages]
    both = F.col("filtering") + F.col("scoring_function")
    return totals.select("*", *per, F.when(both > 0, F.col(total) / both).alias("filter_and_score_pps"))
