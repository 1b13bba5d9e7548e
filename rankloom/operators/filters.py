"""Predicates: staged filters over candidates, group filters, and filters inside nested arrays."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Datasets without tests to run: execution stages pass everything there.
NOT_EXECUTED = ("gsm8k",)


def stage_column(stage: str) -> str:
    """The flag column of a stage: ``execute_3s10t`` is ``e3s10t``; other names stand for themselves."""
    m = re.fullmatch(r"execute_(\d+s\d+t)", stage)
    return f"e{m.group(1)}" if m else stage


def staged_filter(candidates: DataFrame, flags: DataFrame, on: Sequence[str], stage: str, remove_timeouts: bool = False, missing: str = "error", dataset: str | None = "dataset") -> DataFrame:
    """Candidates with ``keep``: the stage's flag, or, unless ``remove_timeouts``, its timeout.

    Candidates without a flag are an error (``missing='error'``), pruned (``'prune'``) or kept (``'keep'``). Execution stages
    keep everything of datasets that aren't executed.
    """
    flag, late = stage_column(stage), f"{stage_column(stage)}_timeout"
    f = flags.select(*on, F.col(flag).alias("__flag"), F.coalesce(F.col(late), F.lit(False)).alias("__late"))
    d = candidates.join(f, list(on), "left")
    keep = F.col("__flag") if remove_timeouts else F.col("__flag") | F.col("__late")
    if missing == "error":
        keep = F.when(F.col("__flag").isNull(), F.raise_error(F.lit(f"candidate without flag {flag}"))).otherwise(keep)
    else:
        keep = F.coalesce(keep, F.lit(missing == "keep"))
    if flag.startswith("e") and flag != stage and dataset and dataset in candidates.columns:
        keep = F.when(F.col(dataset).isin(*NOT_EXECUTED), F.lit(True)).otherwise(keep)
    return d.withColumn("keep", keep.cast("boolean")).drop("__flag", "__late")


def split_kept(filtered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned), without the flag."""
    return filtered.filter("keep").drop("keep"), filtered.filter(~F.col("keep")).drop("keep")


def prune_scores(scored: DataFrame, keep: str = "keep", score: str = "score") -> DataFrame:
    """The union of scored and pruned candidates: a pruned one has score -infinity and time 0 and is marked."""
    k = F.coalesce(F.col(keep), F.lit(False))
    out = scored.withColumn(score, F.when(k, F.col(score)).otherwise(float("-inf"))).withColumn("filtered_out", ~k)
    return out.withColumn("score_time", F.when(k, F.col("score_time")).otherwise(0.0)) if "score_time" in out.columns else out


def usable_problem(predictions: Column, invalid: Column, level: str = "passed", require_both: bool = True, with_syntax: bool = False, max_chars: int = 10_000) -> Column:
    """Whether a training problem is kept: a usable program (shorter than ``max_chars``), one that passes at ``level``, and,
    if both are required, one that fails; programs with invalid syntax count as failing if they are included."""
    short = F.filter(predictions, lambda p: F.length(p["code"]) < max_chars)
    passing = F.exists(short, lambda p: F.coalesce(p[level], F.lit(False)))
    failing = F.exists(short, lambda p: ~F.coalesce(p[level], F.lit(False)))
    if with_syntax:
        failing = failing | (F.size(F.filter(invalid, lambda p: F.length(p["code"]) < max_chars)) > 0)
    keep = (F.size(short) > 0) & passing
    return keep & failing if require_both else keep


def usable_problems(df: DataFrame, keys: Sequence[str], code: str, level: str = "passed", require_both: bool = True, invalid: Column | None = None, max_chars: int = 10_000) -> DataFrame:
    """The same over flat candidates, ``keys, keep``: nothing of a problem is brought together. ``invalid`` marks programs with
    invalid syntax, which count as failing and as nothing else; without it there are none."""
    bad = F.lit(False) if invalid is None else F.coalesce(invalid, F.lit(False))
    short = F.coalesce(F.length(code) < max_chars, F.lit(False))
    ok = F.coalesce(F.col(level), F.lit(False))
    passing, failing = F.bool_or(short & ~bad & ok), F.bool_or(short & (bad | ~ok))
    return df.groupBy(*keys).agg((passing & failing if require_both else passing).alias("keep"))


def drop_long_programs(predictions: Column, max_chars: int) -> Column:
    """The programs of an array that have at most ``max_chars`` characters."""
    return F.filter(predictions, lambda p: F.length(p["code"]) <= max_chars)


def mixed_outcomes(df: DataFrame, keys: Sequence[str], passed: str = "passed") -> DataFrame:
    """Keys of the groups in which some but not all pass."""
    p = F.coalesce(F.col(passed), F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(p).alias("passing"), F.count(F.lit(1)).alias("total")).filter("passing > 0 and passing < total")


def complete_groups(df: DataFrame, group: Sequence[str], member: str, expected: DataFrame) -> DataFrame:
    """Rows of the groups that hold every expected member (``expected``: one column named as ``member``)."""
    want = expected.select(member).filter(F.col(member).isNotNull()).distinct()
    need = want.agg(F.count(F.lit(1)).alias("__need"))
    have = df.select(*group, member).distinct().join(want, member, "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("__have"))
    full = have.crossJoin(F.broadcast(need)).filter("__have = __need").select(*group)
    return df.join(full, list(group), "left_semi")


def has_public_tests(tests: Column) -> Column:
    return F.size(tests["input"]) > 0
