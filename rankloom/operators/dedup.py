"""The four ways in which repeated candidates are merged. They differ in what survives; none keeps input order by itself,
so that positions (``pos``) are carried as data.

Texts are grouped as they are: partial aggregation leaves one row per different text and map task, so that a text that
makes up most of a table moves once per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

NEG_INF = float("-inf")


def dedup_max_logprob(df: DataFrame, keys: Sequence[str], text: Column, pos: str, logprob: str = "logprob", completion: str = "completion_id", first: Sequence[str] = ()) -> DataFrame:
    """One row per problem and text: ``count``, the largest logprob (null if none, or if it is 0), the smallest completion,
    the columns of ``first`` from the first row, and ``pos`` of that row.

    A null text is an error upstream; such rows are left out.
    """
    d = df.withColumn("__text", text).filter(F.col("__text").isNotNull())
    best = F.max(logprob)
    out = d.groupBy(*keys, "__text").agg(
        F.count(F.lit(1)).alias("count"),
        F.when(best != 0, best).alias(logprob),
        F.min(completion).alias(completion),
        *[F.min_by(c, pos).alias(c) for c in first],
        F.min(pos).alias(pos),
    )
    return out.withColumnRenamed("__text", "text")


def dedup_min_numeric(df: DataFrame, keys: Sequence[str], text: Column, pos: str) -> DataFrame:
    """One row per problem and text: the smallest of every numeric column, the conjunction of every boolean one, the last
    of every other, and ``count``."""
    d = df.withColumn("__text", text).filter(F.col("__text").isNotNull())
    aggs = []
    for f in df.schema.fields:
        if f.name in (*keys, pos):
            continue
        if isinstance(f.dataType, BooleanType):
            aggs.append(F.bool_and(f.name).alias(f.name))
        elif isinstance(f.dataType, NumericType):
            aggs.append(F.min(f.name).alias(f.name))
        else:
            aggs.append(F.max_by(f.name, pos).alias(f.name))
    return d.groupBy(*keys, "__text").agg(F.count(F.lit(1)).alias("dup_count"), F.min(pos).alias(pos), *aggs).drop("__text")


def merged_with_syntax(df: DataFrame, keys: Sequence[str], text: Column, valid: Column, mins: Sequence[str], passed: str = "passed") -> DataFrame:
    """One row per problem and stripped text with the smallest of ``mins``, ``count`` and ``valid``. Each different text is parsed
    once; write the result before both sides of ``split_valid`` are used."""
    out = df.withColumn("text", text).filter(F.col("text").isNotNull())
    out = out.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("count"), F.bool_or(passed).alias(passed), *[F.min(m).alias(m) for m in mins])
    return out.withColumn("valid", valid)


def split_valid(out: DataFrame, passed: str = "passed") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) programs; invalid ones have not passed."""
    return out.filter("valid").drop("valid"), out.filter(~F.col("valid")).drop("valid").withColumn(passed, F.lit(False))


def dedup_split_syntax(df: DataFrame, keys: Sequence[str], text: Column, valid: Column, mins: Sequence[str], passed: str = "passed") -> tuple[DataFrame, DataFrame]:
    """Both in one: (valid, invalid) merged programs."""
    return split_valid(merged_with_syntax(df, keys, text, valid, mins, passed), passed)


def percent_unique(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Over all problems: rows, unique texts, their ratio, and the mean number of unique texts per problem."""
    per = df.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("unique"))
    return per.agg(F.sum("rows").alias("rows"), F.sum("unique").alias("unique_rows"), F.try_divide(F.sum("unique"), F.sum("rows")).alias("pct_unique"), F.avg("unique").alias("mean_unique"))


def total_preserved(before: DataFrame, after: DataFrame, count: str = "count") -> DataFrame:
    """One row: the number of rows before, the sum of counts after, and whether they agree."""
    a = before.agg(F.count(F.lit(1)).alias("rows_before"))
    b = after.agg(F.coalesce(F.sum(count), F.lit(0)).alias("count_after"))
    return a.crossJoin(b).withColumn("preserved", F.col("rows_before") == F.col("count_after"))
