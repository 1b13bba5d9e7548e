"""Repeated execution trials: aggregation over trials, agreement, wall times and throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The entries of ``timing`` that become columns. Fixed values.
TIMINGS = ("writing", "execution", "cleanup", "preprocess", "postprocess")


def flatten_timing(df: DataFrame, timing: str = "timing", names: Sequence[str] = TIMINGS) -> DataFrame:
    """The map's known entries as columns ``<name>_time``; missing ones are null, others are dropped."""
    return df.select("*", *[F.col(timing)[f"{n}_time"].alias(f"{n}_time") for n in names]).drop(timing)


def agreement(df: DataFrame, keys: Sequence[str], value: str, trial: str, alias: str) -> DataFrame:
    """Per key: null if all trials agree, else ``value:count`` of each value, in the order of first appearance, joined by ``|``."""
    text = F.coalesce(F.initcap(F.col(value).cast("string")) if dict(df.dtypes)[value] == "boolean" else F.col(value).cast("string"), F.lit("None"))
    per = df.groupBy(*keys, text.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(trial).alias("t"))
    listed = F.array_sort(F.collect_list(F.struct("t", "v", "n")))  # as many entries as different values
    shown = F.array_join(F.transform(listed, lambda x: F.concat(x["v"], F.lit(":"), x["n"].cast("string"))), "|")
    return per.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 1, shown).alias(alias))


def aggregate_trials(df: DataFrame, keys: Sequence[str], trial: str, firsts: Sequence[str], times: Sequence[str]) -> DataFrame:
    """Per key: the first non-null of ``firsts`` by trial, mean and sample deviation of ``times`` (NaN is no value)."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(trial))).alias(c) for c in firsts],
        *[F.avg(clean(c)).alias(c) for c in times],
        *[F.stddev_samp(clean(c)).alias(f"{c}_std") for c in times],
    )


def collapse_trials(df: DataFrame, keys: Sequence[str], passed: str = "passed", timeout: str = "timeout") -> DataFrame:
    """Per key: whether any trial passed, and whether any timed out."""
    return df.groupBy(*keys).agg(F.bool_or(passed).alias("passed"), F.bool_or(timeout).alias("timeout"))


def wall_time(execution: Column, pre: Column, post: Column, net: Column, executed: Column) -> Column:
    """A trial's wall time: execution with its surroundings where programs were run one by one, else the net time."""
    return F.when(executed, execution + F.coalesce(pre, F.lit(0.0)) + F.coalesce(post, F.lit(0.0))).otherwise(net)


def programs_per_second(df: DataFrame, keys: Sequence[str], times: Sequence[str]) -> DataFrame:
    """Per key: rows divided by the mean of each time column, null where that is 0 or missing."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_preds"), *[F.try_divide(F.count(F.lit(1)), F.avg(clean(c))).alias(f"{c.removesuffix('_time')}_pps") for c in times])


def trial_totals(df: DataFrame, trial: str = "trial", passed: str = "passed") -> DataFrame:
    """Per trial: programs, programs that passed, and their share."""
    d = df.groupBy(trial).agg(F.count_if(F.coalesce(F.col(passed), F.lit(False))).alias("programs_passed"), F.count(F.lit(1)).alias("num_preds"))
    return d.withColumn("pct_passed", F.col("programs_passed") / F.col("num_preds"))


def pivot_flags(long: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], passed: str = "passed", timeout: str = "timeout") -> DataFrame:
    """Long filter results as wide flags: per key, for each of the fixed ``names``, the flag and ``<name>_timeout``."""
    aggs = []
    for n in names:
        here = F.col(name) == n
        aggs += [F.bool_or(F.when(here, F.col(passed))).alias(n), F.bool_or(F.when(here, F.col(timeout))).alias(f"{n}_timeout")]
    return long.groupBy(*keys).agg(*aggs)


def repeated(problems: DataFrame, times: int) -> DataFrame:
    """Every row once per trial, numbered from 0."""
    return problems.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
