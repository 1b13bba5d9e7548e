"""Computed columns: outcome decoding, pass levels, record construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.reshape import with_positions

PASS, FAIL, TIMEOUT = "pass", "fail", "timeout"


def decode_status(base_status: Column, plus_status: Column, base: Column, plus: Column) -> dict[str, Column]:
    """``passed, timeout, outcomes`` of a program run on base and further tests, either of which may not have run (null).

    It passes if every part that ran passed; outcomes are the further tests' and then the base tests'.
    """
    ran = lambda s: s.isNotNull()
    ok = lambda s: F.coalesce(s == PASS, F.lit(True))
    passed = (ran(base_status) | ran(plus_status)) & ok(base_status) & ok(plus_status)
    late = F.coalesce(base_status == TIMEOUT, F.lit(False)) | F.coalesce(plus_status == TIMEOUT, F.lit(False))
    none = F.array().cast("array<boolean>")
    return {"passed": passed, "timeout": late, "outcomes": F.concat(F.coalesce(plus, none), F.coalesce(base, none))}


def hidden_outcome(private: Column, generated: Column) -> Column:
    """Both hidden test sets, the known one where the other is null; an error where neither is known."""
    p, g = F.coalesce(private, generated), F.coalesce(generated, private)
    return F.when(p.isNull(), F.raise_error(F.lit("neither private nor generated outcome")).cast("boolean")).otherwise(p & g)


def private_ladder(test_types: Column, private: Column, generated: Column, passed: Column) -> Column:
    """The private outcome: that of private tests (type 1) if there are any, else of generated ones (type 2), else overall."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(F.array_contains(test_types, 1), yes(private)).when(F.array_contains(test_types, 2), yes(generated)).otherwise(yes(passed))


def share_passed(outcomes: Column, total: Column | None = None) -> Column:
    """Passed tests by all tests; missing outcomes are 0."""
    n = F.aggregate(F.coalesce(outcomes, F.array().cast("array<boolean>")), F.lit(0), lambda a, x: a + F.when(x, 1).otherwise(0))
    return F.coalesce(F.try_divide(n, total if total is not None else F.size(outcomes)), F.lit(0.0))


def count_true(outcomes: Column) -> Column:
    return F.size(F.filter(outcomes, lambda x: x))


def completed_outcomes(df: DataFrame) -> DataFrame:
    """A candidate's derived fields: empty ``outcomes`` are ``[passed]`` and give ``num_tests_passed``; empty ``plus_outcomes`` are
    ``[passed_plus]`` and add nothing to it, others add their passes."""
    none = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<boolean>"))) == 0
    base = F.when(none("outcomes"), F.array("passed")).otherwise(F.col("outcomes"))
    plus = F.when(none("plus_outcomes"), F.array("passed_plus")).otherwise(F.col("plus_outcomes"))
    tests = count_true(base) + F.when(none("plus_outcomes"), 0).otherwise(count_true(F.col("plus_outcomes")))
    return df.withColumn("num_tests_passed", tests).withColumn("outcomes", base).withColumn("plus_outcomes", plus)


def tests_by_type(test_types: Column) -> dict[str, Column]:
    of = lambda k: F.size(F.filter(test_types, lambda x: x == k))
    return {name: of(k) for k, name in enumerate(("public", "private", "generated"))}


def elapsed(timing: Column) -> Column:
    """Execution with pre- and postprocessing; null without execution."""
    part = lambda n: F.coalesce(timing[f"{n}_time"], F.lit(0.0))
    return timing["execution_time"] + part("preprocess") + part("postprocess")


def default_passes(df: DataFrame, levels: list[str]) -> DataFrame:
    """Missing outcomes as false."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False) for c in levels})


def problem_record(predictions: Column) -> dict[str, Column]:
    """A problem's record from its predictions: the candidates with positions, and how many pass at each level."""
    count = lambda f: F.size(F.filter(predictions, lambda p: F.coalesce(p[f], F.lit(False))))
    return {"solutions": with_positions(predictions), "num_passed": count("passed"), "num_passed_public": count("passed_public"), "num_passed_plus": count("passed_plus")}


#: The columns of a scored candidate. Fixed values.
SCORED = ("task_id", "sid", "completion_id", "score", "score_time", "passed", "passed_public", "passed_plus", "logprob", "num_tests_passed", "count")


def scored_record(df: DataFrame, pruned: bool = False) -> DataFrame:
    """The columns of a scored candidate, missing ones null; pruned candidates have score -infinity and time 0 and are marked."""
    fixed = {"score": float("-inf"), "score_time": 0.0} if pruned else {}
    cols = [F.lit(fixed[c]) if c in fixed else F.col(c) if c in df.columns else F.lit(1 if c == "count" else None) for c in SCORED]
    return df.select(*[x.alias(c) for c, x in zip(SCORED, cols)], F.lit(pruned).alias("filtered_out"))


def with_split(df: DataFrame, **literals: object) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in literals.items()})
