"""The verification suite as one lazy plan: filter, score, rank, report, with the dataset as a column instead of a loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import code as C
from rankloom.functions.templates import TEMPLATES, example, prompt
from rankloom.functions.text import DUMMY, rstrip_ws
from rankloom.operators import filters as FI
from rankloom.operators import ranking as R
from rankloom.operators import sampling as S
from rankloom.operators.filters import NOT_EXECUTED, stage_column
from rankloom.operators.projections import SCORED
from rankloom.operators.scoring import score_in_batches, scorer
from rankloom.operators.tokenize import truncated_text
from rankloom.plans.config import DataConfig, EvalSuite, PreprocessorConfig, RunConfig
from rankloom.plans.training import problem_text
from rankloom.session import materialize
from rankloom.sources import writers

#: Metrics reported in percent, by the end of their name.
PERCENT = ("rs", "top1", "mrr", "pct_collisions", "b_of_4", "b_of_16", "b_of_64")


def scaled(long: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Metrics whose name ends as one in percent, times 100."""
    hit = F.lit(False)
    for end in PERCENT:
        hit = hit | F.col(metric).endswith(end)
    return long.withColumn(value, F.when(hit, 100 * F.col(value)).otherwise(F.col(value)))


def rendered(candidates: DataFrame, cfg: PreprocessorConfig, suite: EvalSuite | None = None, problem: str = "problem", program: str = "solution") -> DataFrame:
    """Candidates with ``query``, the prompt to score, and ``problem_dummy``, what of it comes before the program: with the
    task's worked examples, the problem cut to the setting's tokens, and without trailing space where the suite says so."""
    t = TEMPLATES[cfg.template]
    text = F.col(problem) if cfg.max_problem_tokens is None else truncated_text(F.col(problem), cfg.max_problem_tokens)
    d = candidates.withColumn(problem, text)

    def by_task(make: Callable[[list[str]], Column]) -> Column:
        shots = {x.name: [example(t, *e) for e in x.icl_examples] for x in suite.tasks if x.icl_examples} if suite else {}
        out = make([])
        for name, examples in shots.items():
            out = F.when(F.col("dataset") == name, make(examples)).otherwise(out)
        return out

    full = lambda code: by_task(lambda shots: prompt(t, F.col(problem), code, cfg.prompt_newline, examples=shots, instruction=cfg.instruction))
    query = full(F.col(program))
    return d.withColumn("query", rstrip_ws(query) if suite and suite.rstrip_query else query).withColumn("problem_dummy", F.substring_index(full(F.lit(DUMMY)), DUMMY, 1))


def prepared(candidates: DataFrame, suite: EvalSuite, program: str = "solution") -> DataFrame:
    """Candidates with their programs cleaned as their task's settings say, whatever their length."""
    out = candidates
    for (clean, comments), make in {(True, False): C.format_code, (False, True): C.strip_comments, (True, True): C.clean_code}.items():
        names = [t.name for t in suite.tasks if (bool(t.clean_solutions), bool(t.remove_comments)) == (clean, comments)]
        if names:
            out = out.withColumn(program, F.when(F.col("dataset").isin(names), make(F.col(program))).otherwise(F.col(program)))
    return out


@dataclass(frozen=True)
class Model:
    """A model's side of a scorer: ``run`` takes a batch's rows (with ``query``) and gives ``outputs`` (DDL) for each, and
    ``columns`` names those that the scorer takes, in its order."""

    run: Callable[[pd.DataFrame], pd.DataFrame]
    outputs: str
    columns: tuple = ()


def evaluate(candidates: DataFrame, texts: DataFrame, run: RunConfig, model: Model, flags: DataFrame | None = None, timings: DataFrame | None = None, missing: str = "error", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One evaluation from candidates to report: (scored candidates with the pruned ones, the long report).

    ``candidates``: ``task_id, sid, dataset, solution`` and outcomes; ``texts``: ``task_id, problem`` (and ``docstring``); ``flags``: the
    wide filter flags; ``timings``: ``generator, sampling_setup, dataset, filter_name, time``. Cheap filters come first, so that only
    kept candidates are cleaned, rendered and scored, in batches of the setting's tokens. With ``folder`` the candidates are
    written as JSON lines and the report as one document, ``dataset/metric`` to value.
    """
    s, c = run.suite, run.scoring

    def score(kept: DataFrame) -> DataFrame:
        d = prepared(kept, s).join(texts, "task_id", "left")
        if "docstring" in texts.columns:
            d = d.withColumn("problem", problem_text(F.col("dataset"), F.col("problem"), F.col("docstring")))
        d = rendered(d, run.preprocessing, s).withColumn("query_tokens", F.octet_length("query"))
        d = score_in_batches(d, model.run, model.outputs, "query_tokens", "sid", c.max_tokens_per_batch)
        return scorer(c.method)(d, *[F.col(x) if isinstance(x, str) else x for x in model.columns])

    done = materialize(scored_parts(run_suite(candidates, flags, s, score, missing=missing)), "evaluated")
    report = suite_report(done, s)
    if timings is not None and s.filter_stage is not None:
        report = report.unionByName(stage_seconds(timings, run))
    if folder is not None:
        writers.jsonl(done, f"{folder}/results")
        writers.metrics_json(done.sparkSession, report, f"{folder}/overall.json", task="dataset")
    return done, report


def scored_parts(d: DataFrame) -> DataFrame:
    """The columns of scored candidates with their dataset."""
    return d.select("dataset", *[F.col(c) if c in d.columns else F.lit(None).alias(c) for c in SCORED if c != "sid"], F.col("sid"), "filtered_out")


def stage_seconds(timings: DataFrame, run: RunConfig) -> DataFrame:
    """``dataset, metric, value``: the mean seconds of the run's filter stage on each dataset, 0 where nothing is executed."""
    stage = stage_column(run.suite.filter_stage)
    t = timings.filter((F.col("generator") == run.generator) & (F.col("sampling_setup") == run.sampling_setup) & (F.col("filter_name") == stage))
    t = t.filter(F.col("time").isNotNull() & ~F.isnan("time") & F.col("dataset").isin([x.name for x in run.suite.tasks]))
    free = F.col("dataset").isin(*NOT_EXECUTED) & F.lit(stage != run.suite.filter_stage)
    return t.groupBy("dataset").agg(F.avg("time").alias("value")).select("dataset", F.lit("filtering").alias("metric"), F.when(free, 0.0).otherwise(F.col("value")).alias("value"))


def run_suite(candidates: DataFrame, flags: DataFrame | None, suite: EvalSuite, score: Callable[[DataFrame], DataFrame] | None = None, on: tuple[str, ...] = ("task_id", "sid"), missing: str = "error") -> DataFrame:
    """Candidates of the suite's tasks, filtered, scored and joined with the pruned ones.

    The cheap filter lies below the scorer, so only kept candidates reach it. ``score`` adds ``score``; without it the
    column is there already.
    """
    d = candidates.filter(F.col("dataset").isin([t.name for t in suite.tasks]))
    if suite.filter_stage is None:
        kept, pruned = d, None
    else:
        kept, pruned = FI.split_kept(FI.staged_filter(d, flags, on, suite.filter_stage, suite.remove_timeouts, missing))
    out = (score(kept) if score else kept).withColumn("filtered_out", F.lit(False))
    if pruned is not None:
        gone = pruned.withColumn("score", F.lit(float("-inf"))).withColumn("score_time", F.lit(0.0)).withColumn("filtered_out", F.lit(True))
        out = out.unionByName(gone, allowMissingColumns=True)
    return out


def suite_report(scored: DataFrame, suite: EvalSuite, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Long report ``dataset, metric, value``: macro averages per dataset, collisions, candidates and pruned ones."""
    keys = [*by, "task_id"]
    ranked = R.rank_intervals(scored, keys, flags=["passed"])
    per = R.problem_metrics(ranked, keys, ks=suite.ks, ties=True, pruned="filtered_out")
    names = ["rs", "mrr", "top1", *[f"b_of_{k}" for k in suite.ks]]
    total = lambda c: F.sum(c).cast("double").alias(c)
    wide = per.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("problems"), *[F.avg(m).alias(m) for m in names], *[total(c) for c in ("num_collisions", "unique_preds", "pruned")])
    wide = wide.withColumn("pct_collisions", F.try_divide("num_collisions", "unique_preds"))
    return scaled(wide.unpivot(list(by), [c for c in wide.columns if c not in by], "metric", "value"))


def training_rows(problems: DataFrame, cfg: DataConfig) -> DataFrame:
    """Pointwise training rows from flat candidates (``task_id, sid, solution, passed, valid``)."""
    d = problems.filter((F.length("solution") <= cfg.max_prog_chars) & F.col("solution").isNotNull())
    if not cfg.include_failed:
        d = d.filter(F.coalesce(F.col(cfg.pass_level), F.lit(False)))
    if not cfg.include_syntax and "valid" in d.columns:
        d = d.filter("valid")
    d = S.pointwise_sample(d, "task_id", "sid", cfg.examples_per_problem, cfg.seed)
    return S.sample_rows(d, "sid", cfg.num_train_examples, cfg.seed) if cfg.num_train_examples else d
