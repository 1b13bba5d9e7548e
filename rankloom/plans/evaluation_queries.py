"""Whole evaluations: candidates filtered, rendered, scored in batches and reported, with their SQL twins; and trials."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import templates as T
from rankloom.operators import joins as J
from rankloom.operators import trials as TR
from rankloom.plans import relational_queries as Q
from rankloom.plans import training as TN
from rankloom.plans.config import TWO_SHOTS, EvalSuite, PreprocessorConfig, RunConfig, ScoringConfig, TaskConfig, suite
from rankloom.plans.fixtures import TRIALS, trials
from rankloom.plans.ranking_queries import _metrics, rounded
from rankloom.plans.source_queries import scratch
from rankloom.plans.suite import Model, evaluate, stage_seconds
from rankloom.session import spread, table
from rankloom.sources import readers

#: The stages that the trials stand for here, by trial.
BY_TRIAL = ["is_valid_syntax", "has_no_lint_errors", "e3s1t", "e3s2t", "e3s10t"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, each once: the delivery of smallest key."""
    d = table(spark, sf_dir, "solutions").filter("task_id is not null and sid is not null and solution is not null")
    cols = ["solution", "passed", "passed_public", "passed_plus", "completion_id", "logprob", "num_tests_passed", "count"]
    d = d.groupBy("task_id", "sid").agg(F.min_by(F.struct(*cols), "solution_key").alias("c")).select("task_id", "sid", "c.*")
    return d.withColumn("dataset", F.substring_index("task_id", "/", 1))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every problem, of whatever split: that of the smallest key."""
    p = table(spark, sf_dir, "problems").filter("task_id is not null")
    return p.groupBy("task_id").agg(F.min_by("description", "problem_key").alias("problem"))


def stage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, BY_TRIAL)), F.pmod(F.col("trial"), F.lit(5)) + 1)
    long = trials(spark, sf_dir).select("task_id", F.col("sid").cast("int").alias("sid"), names.alias("filter_name"), "passed", "timeout")
    return TR.pivot_flags(long, ["task_id", "sid"], "filter_name", BY_TRIAL)


def by_length(rows: pd.DataFrame) -> pd.DataFrame:
    """A model in place of one: logits from the length of the query, so that any engine gives the same."""
    n = rows["query"].str.len()
    return pd.DataFrame({"passing": [[x % 97 / 97, x % 89 / 89] for x in n], "failing": [[x % 83 / 83, x % 79 / 79] for x in n]})


MODEL = Model(by_length, "passing array<double>, failing array<double>", ("passing", "failing"))


def _report(spark, sf_dir, s: EvalSuite, method: str = "binary_logit") -> DataFrame:
    run = RunConfig("ardent-7b", "t0.4_n128", s, ScoringConfig(method, 4096), PreprocessorConfig())
    _, report = evaluate(candidates(spark, sf_dir), texts(spark, sf_dir), run, MODEL, stage_flags(spark, sf_dir) if s.filter_stage else None, missing="prune")
    return rounded(report)


def suite_two_shot(spark, sf_dir):
    return _report(spark, sf_dir, suite("two_shot"))


def suite_3s2t(spark, sf_dir):
    return _report(spark, sf_dir, suite("zero_shot_3s2t"))


def suite_filtered(spark, sf_dir):
    """The syntax stage, without its timeouts, before log-probability scores."""
    s = EvalSuite("strict", tasks=(TaskConfig("mbpp"), TaskConfig("gsm8k")), filter_stage="is_valid_syntax", remove_timeouts=True)
    return _report(spark, sf_dir, s, "binary_logprob")


def suite_files(spark, sf_dir):
    """An evaluation's files, read again: its candidates as JSON lines, and its report."""
    folder = scratch(spark, "evaluation")
    s = suite("debug_filter")
    s = EvalSuite(s.name, tasks=(TaskConfig("mbpp"),), filter_stage=s.filter_stage)
    run = RunConfig("ardent-7b", "t0.4_n128", s, ScoringConfig("binary_logit", 4096))
    evaluate(candidates(spark, sf_dir), texts(spark, sf_dir), run, MODEL, stage_flags(spark, sf_dir), missing="prune", folder=folder)
    doc = readers.document(spark, f"{folder}/overall.json")
    back = spark.read.schema("task_id string, sid int, score string, filtered_out boolean").json(f"{folder}/results")
    out = back.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("filtered_out").alias("pruned"), F.count_if(F.col("score") == "-Infinity").alias("lowest"))
    return out.withColumn("reported", F.lit(int(doc["mbpp/pruned"])).cast("bigint"))


def stage_times(spark, sf_dir):
    """The mean seconds of a run's filter stage by dataset."""
    f = table(spark, sf_dir, "filter_timings_summary")
    first = f.filter("generator is not null and sampling_setup is not null").agg(F.min(F.struct("generator", "sampling_setup")).alias("c")).first().c
    run = RunConfig(first.generator, first.sampling_setup, EvalSuite("s", filter_stage="is_valid_syntax"))
    return rounded(stage_seconds(f, run), 4)


def missing_cells(spark, sf_dir):
    """The cells of the grid of models, setups and datasets that were never sampled."""
    d = table(spark, sf_dir, "solutions").filter("model is not null and setup is not null and dataset is not null")
    return J.missing_cells(d, ["model", "setup", "dataset"])


def trial_driver(spark, sf_dir):
    """Three syntax trials of the candidates: run, written, read and aggregated. Valid programs differ by no trial."""
    d = spread(candidates(spark, sf_dir).filter("task_id like 'mbpp%'"))
    out = TN.run_trials(d, TN.syntax_stage, 3, scratch(spark, "driver"))
    return out.select("task_id", "sid", "trials", "passed", "timeout", "return_code", "passed_vals", (F.col("execution_time") > 0).alias("timed"))


QUERIES = {f.__name__: f for f in (suite_two_shot, suite_3s2t, suite_filtered, suite_files, stage_times, missing_cells, trial_driver)}

_NL = "chr(10)"
_Q = lambda x: "'" + x.replace("'", "''") + "'"
_SHOTS = "".join(f"# Example {i}:\n{e}\n\n" for i, e in enumerate((T.example(T.TEMPLATES["qsol_task"], *x) for x in TWO_SHOTS), 1)) + "# Example 3:\n"
_FLAGS = f"""{TRIALS}, long as (select task_id, sid::int sid, list_extract({BY_TRIAL!r}, (trial % 5) + 1) f, passed, timeout from trials),
flags as (select task_id, sid, {", ".join(f"bool_or(passed) filter (f = '{n}') {n}, bool_or(timeout) filter (f = '{n}') {n}_timeout" for n in BY_TRIAL)} from long group by 1, 2)"""


def _evaluation(datasets: tuple[str, ...], keep: str = "true", head: str = "", score: str = "(p1 + p2) / 2") -> str:
    """Candidates with ``score`` and ``filtered_out``, and the ranking's intervals over them."""
    return f"""{_FLAGS}, cand as (select distinct on (task_id, sid) *, split_part(task_id, '/', 1) ds from solutions where task_id is not null and sid is not null and solution is not null order by solution_key),
p as (select task_id, arg_min_null(description, problem_key) problem from problems where task_id is not null group by 1),
k as (select c.*, coalesce({keep}, false) keep, length({_Q(head)} || case when length(coalesce(problem, '')) > 0 then '# Question' || {_NL} || problem || {_NL} || {_NL} else {_NL} end
  || '# Proposed Solution' || {_NL} || '```python' || {_NL} || solution || {_NL} || '```' || {_NL}) n
  from cand c left join p using (task_id) left join flags f on f.task_id = c.task_id and f.sid = c.sid where ds in {datasets!r}),
g as (select *, n % 97 / 97::double p1, n % 89 / 89::double p2 from k),
sc as (select *, case when keep then {score} else '-infinity'::double end eff, greatest(coalesce(count, 1), 1)::bigint w from g),
iv as (select *, hi - w lo from (select *, sum(w) over (partition by task_id order by eff desc, sid rows unbounded preceding)::bigint hi from sc)),
x as (select task_id, passed, i from (select *, unnest(range(lo, hi)) i from iv)),
m as ({_metrics('passed', (4, 16, 64))}), c as (select task_id, eff, sum(w) c, count(*) u, count(*) filter (not keep) gone from iv group by 1, 2),
a as (select split_part(task_id, '/', 1) dataset, count(*)::double problems, 100 * avg(rs) rs, 100 * avg(mrr) mrr, 100 * avg(top1) top1, 100 * avg(b_of_4) b_of_4, 100 * avg(b_of_16) b_of_16, 100 * avg(b_of_64) b_of_64 from m group by 1),
b as (select split_part(task_id, '/', 1) dataset, (count(*) filter (c > 1))::double num_collisions, sum(u)::double unique_preds, 100 * (count(*) filter (c > 1)) / sum(u)::double pct_collisions, sum(gone)::double pruned from c group by 1),
r as (select * from a join b using (dataset))"""


_REPORT = 'select dataset, metric, round(v, 6) "value" from (unpivot r on columns(* exclude (dataset)) into name metric value v)'

SQL = {
    "suite_two_shot": f"with {_evaluation(('code_contests', 'gsm8k', 'mbpp', 'humaneval'), head=_SHOTS)} {_REPORT}",
    "suite_3s2t": f"with {_evaluation(('humaneval', 'mbpp', 'code_contests'), 'f.e3s2t or coalesce(f.e3s2t_timeout, false)')} {_REPORT}",
    "suite_filtered": f"with {_evaluation(('mbpp', 'gsm8k'), 'f.is_valid_syntax', score='(p1 + p2) / 3')} {_REPORT}",
    "suite_files": f"with {_evaluation(('mbpp', 'mbpp'), 'f.e3s1t or coalesce(f.e3s1t_timeout, false)')} select count(*) candidates, count(*) filter (not keep) pruned, count(*) filter (not keep) lowest, count(*) filter (not keep) reported from iv",
    "stage_times": """with c as (select min((generator, sampling_setup)) c from filter_timings_summary where generator is not null and sampling_setup is not null)
select dataset, 'filtering' metric, round(avg(time), 4) "value" from filter_timings_summary where (generator, sampling_setup) = (select c from c) and filter_name = 'is_valid_syntax' and time is not null and not isnan(time)
and dataset in ('code_contests', 'gsm8k', 'mbpp', 'humaneval') group by 1""",
    "missing_cells": """with d as (select * from solutions where model is not null and setup is not null and dataset is not null)
select model, setup, dataset from (select distinct model from d), (select distinct setup from d), (select distinct dataset from d) where (model, setup, dataset) not in (select (model, setup, dataset) from d)""",
}
