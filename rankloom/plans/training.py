"""Training and validation sets: predicates on candidates, sampling, rendering, tokens, as one plan each."""

from __future__ import annotations

import re
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import code as C
from rankloom.functions import templates as T
from rankloom.operators import sampling as S
from rankloom.operators import trials as TR
from rankloom.plans.config import DataConfig
from rankloom.sources import readers, writers


def problem_text(dataset: Column, text: Column, docstring: Column) -> Column:
    """A problem's text: the docstring of its last function where the dataset states problems as programs."""
    return F.when(dataset == "humaneval", F.coalesce(docstring, text)).otherwise(text)


def cleaned_programs(candidates: DataFrame, program: str, remove_comments: bool = True, format_code: bool = False, longest: int | None = 10_000) -> DataFrame:
    """Candidates with cleaned programs; those longer than ``longest`` stay as they are (training; evaluation cleans all)."""
    out = F.col(program)
    if remove_comments:
        out = C.strip_comments(out)
    if format_code:
        out = C.format_code(out)
    return candidates.withColumn(program, out if longest is None else F.when(F.length(program) > longest, F.col(program)).otherwise(out))


def pointwise(candidates: DataFrame, cfg: DataConfig, template: str = "qsol_task") -> DataFrame:
    """``task_id, sid, query, completion, passed``: sampled candidates, rendered."""
    t = T.TEMPLATES[template]
    d = candidates.filter(F.col("solution").isNotNull() & (F.length("solution") <= cfg.max_prog_chars))
    if not cfg.include_failed:
        d = d.filter(F.coalesce(F.col(cfg.pass_level), F.lit(False)))
    d = S.pointwise_sample(d, "task_id", "sid", cfg.examples_per_problem, cfg.seed)
    ok = F.coalesce(F.col(cfg.pass_level), F.lit(False))
    return d.select("task_id", "sid", T.prompt(t, F.col("problem"), F.col("solution"), newline=True).alias("query"), T.completion(t, ok).alias("completion"), ok.alias("passed"))


def pairwise(candidates: DataFrame, cfg: DataConfig, template: str = "qsol_task") -> DataFrame:
    """``task_id, rn, prompt, chosen, rejected``: a passing and a failing program after the prompt that both share."""
    t = T.TEMPLATES[template]
    d = candidates.filter(F.col("solution").isNotNull() & (F.length("solution") <= cfg.max_prog_chars))
    pairs = S.pairwise_sample(d, "task_id", "sid", cfg.pass_level, max(cfg.examples_per_problem, 1), cfg.seed)
    side = lambda name: d.select("task_id", F.col("sid").alias(name), F.col("solution").alias(f"{name}_solution"))
    texts = d.groupBy("task_id").agg(F.min("problem").alias("problem"))
    j = pairs.join(side("chosen"), ["task_id", "chosen"]).join(side("rejected"), ["task_id", "rejected"]).join(texts, "task_id")
    pre = T.prefix(t, F.col("problem"))
    end = F.lit(t.after_program)
    return j.select("task_id", "rn", pre.alias("prompt"), F.concat("chosen_solution", end).alias("chosen"), F.concat("rejected_solution", end).alias("rejected"))


def validation_rows(candidates: DataFrame, per_problem: int, template: str = "qsol_task") -> DataFrame:
    """The first ``per_problem`` candidates of each problem, numbered, with the prompt and what precedes the program."""
    t = T.TEMPLATES[template]
    d = S.first_per_group(candidates.filter("solution is not null"), ["task_id"], [F.col("sid")], per_problem)
    return d.select(
        "task_id", "sid", F.concat_ws("/", "task_id", F.col("sid").cast("string")).alias("idx"), T.prompt(t, F.col("problem"), F.col("solution"), newline=True).alias("query"),
        T.prefix(t, F.col("problem")).alias("problem_dummy"), "passed",
    )


#: What a trial of a stage makes of a batch of programs, in order: passed, timeout, had_error, return_code, score, seconds.
Stage = Callable[[list[str | None]], list[tuple[bool, bool, bool, int, float | None, float]]]


def syntax_stage(programs: list[str | None]) -> list[tuple[bool, bool, bool, int, float | None, float]]:
    """A program passes if it can be parsed; a null one fails."""
    out = []
    for p in programs:
        began = time.perf_counter()
        ok = p is not None and C.is_valid(p)
        out.append((ok, False, not ok, int(not ok), None, time.perf_counter() - began))
    return out


def lint_stage(command: Sequence[str] = ("pylint", "--score=y", "--reports=n"), timeout: float = 30.0, least: float | None = None) -> Stage:
    """A stage that runs a linter on each program's file: it passes without errors and fatal messages, and with ``least`` at that
    score. Its report is read as ``functions.text.lint_report`` reads it. Without the linter every program had an error."""

    def run(programs: list[str | None]) -> list[tuple[bool, bool, bool, int, float | None, float]]:
        out = []
        for p in programs:
            began, late, code, text = time.perf_counter(), False, 127, ""
            with tempfile.NamedTemporaryFile("w", suffix=".py") as f:  # the linter's input only, read by its own process
                f.write(p or "")
                f.flush()
                try:
                    done = subprocess.run([*command, f.name], capture_output=True, text=True, timeout=timeout)
                    code, text = done.returncode, done.stdout
                except subprocess.TimeoutExpired:
                    late = True
                except OSError:
                    pass
            rated = re.search(r"rated at (\d+\.\d+)/10", text)
            score = float(rated[1]) if rated else None
            wrong = len(re.findall(r":[0-9]+:[0-9]+: [EF][0-9]+:", text))
            broken = p is None or late or code in (32, 127)
            passed = not broken and not wrong and (least is None or (score is not None and score >= least))
            out.append((passed, late, broken, code, score, time.perf_counter() - began))
        return out

    return run


def stage_trials(candidates: DataFrame, stage: Stage, trials: int, program: str = "solution") -> DataFrame:
    """Trial rows ``trial, task_id, sid, timeout, had_error, return_code, passed, score, timing``: the stage is run anew on every
    program in each trial (``task_id, sid`` and the program are read)."""
    schema = "trial int, task_id string, sid string, timeout boolean, had_error boolean, return_code int, passed boolean, score double, timing map<string,double>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            programs = b["program"].where(b["program"].notna(), None).tolist()
            for n in range(trials):
                got = stage(programs)
                rows = [(n, t, s, late, bad, code, ok, score, {"execution_time": took}) for t, s, (ok, late, bad, code, score, took) in zip(b["task_id"], b["sid"], got)]
                yield pd.DataFrame(rows, columns=["trial", "task_id", "sid", "timeout", "had_error", "return_code", "passed", "score", "timing"])

    d = candidates.select("task_id", F.col("sid").cast("string").alias("sid"), F.col(program).alias("program"))
    return d.mapInPandas(work, schema)


def run_trials(candidates: DataFrame, stage: Stage, trials: int, folder: str, program: str = "solution") -> DataFrame:
    """The trial driver: each trial is run and written to its file in ``folder``; then all are read back and aggregated by
    candidate. ``results.parquet`` beside them holds the aggregate, which is returned: trials, first outcomes with their
    homogeneity, mean and deviation of the time.

    A trial that was lost with its executor is run again by itself; written ones stay.
    """
    spark = candidates.sparkSession
    for n in range(trials):
        rows = stage_trials(candidates, stage, 1, program).withColumn("trial", F.lit(n))
        writers.trial(rows, folder, n)
    got = TR.flatten_timing(readers.trial_results(spark, folder))
    key = ["task_id", "sid"]
    out = TR.aggregate_trials(got, key, "trial", ["passed", "timeout", "return_code"], ["execution_time"])
    out = out.join(TR.agreement(got, key, "passed", "trial", "passed_vals"), key)
    out.write.mode("overwrite").parquet(f"{folder}/results.parquet")
    return spark.read.schema(out.schema).parquet(f"{folder}/results.parquet")


def syntax_trials(candidates: DataFrame, trials: int = 1) -> DataFrame:
    """Trial rows of the syntax stage."""
    return stage_trials(candidates, syntax_stage, trials)


def latest_checkpoint(names: DataFrame, name: str = "name") -> DataFrame:
    """The checkpoint whose name ends in the largest number, of equal ones the last by name."""
    n = F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint")
    return names.filter(F.col(name).isNotNull()).agg(F.max_by(name, F.struct(n, F.col(name))).alias(name))
