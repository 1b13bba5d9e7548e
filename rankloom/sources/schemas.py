"""Schemas of the records. They are declared, never inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_CANDIDATE = (
    "sid int, completion_id int, solution string, passed boolean, passed_public boolean, passed_plus boolean, timed_out boolean, logprob double, count int, elapsed double, "
    "num_tests_passed int, outcomes array<boolean>, plus_outcomes array<boolean>"
)
_PREDICTION = "code: string, passed: boolean, passed_public: boolean, passed_private: boolean, pct_passed: double, count: int"
_TESTS = "struct<input: array<string>, output: array<string>>"


def _nested(fields: str) -> str:
    return "array<struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in fields.split(", "))) + ">>"


DDL = {
    "candidate": _CANDIDATE,
    "problem": f"task_id string, num_passed int, num_pub_tests int, num_plus_tests int, num_passed_plus int, num_passed_public int, solutions {_nested(_CANDIDATE)}, model string, setup string, dataset string",
    "scored": "task_id string, sid int, completion_id int, score double, score_time double, passed boolean, passed_public boolean, passed_plus boolean, logprob double, num_tests_passed int, count int, filtered_out boolean",
    "trial_row": "trial int, task_id string, sid string, timeout boolean, had_error boolean, return_code int, num_ran int, num_passed int, passed boolean, passed_public boolean, passed_private boolean, passed_generated boolean, timing map<string,double>",
    "trial_overall": "trial int, net_time double, execution_time double, preprocessing_time double, postprocessing_time double, programs_passed int, num_preds int, pps double",
    "filter_flags": "generator string, sampling_setup string, dataset string, task_id string, sid int, " + ", ".join(f"{n} boolean, {n}_timeout boolean" for n in ("is_valid_syntax", "has_no_lint_errors", "e3s1t", "e3s3t", "e3s10t")),
    "filter_timing": "generator string, sampling_setup string, dataset string, filter_name string, time double",
    "raw_prediction": "row_id int, query string, prompt_tokens int, task_id string, predictions array<struct<completion_id: int, prediction: string, cumulative_logprob: double, num_tokens: int>>",
    "shard_prediction": "idx int, task_id string, split string, name string, query string, predictions array<string>, cum_log_probs array<double>, num_tokens array<int>",
    "train_problem": f"task_id string, description string, source string, predictions array<struct<{_PREDICTION}>>, invalid_syntax array<struct<{_PREDICTION}>>, num_passed int, num_passed_public int, num_passed_private int",
    "execution_problem": f"task_id string, model string, sampling_setup string, solutions array<struct<solution: string, sid: string>>, source string, name string, public_tests {_TESTS}, private_tests {_TESTS}, generated_tests {_TESTS}, test_types array<int>, time_limit int, memory_limit_bytes int, answer string",
    "few_shot": "questions array<string>, solutions array<string>",
    "scores": "inference double, get_ds_scores double, scoring_function double, evaluation double, overall double, filtering double",
}


def schema(name: str) -> StructType:
    """A record's schema by name."""
    return StructType.fromDDL(DDL[name])
