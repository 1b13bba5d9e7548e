"""Queries over dedup, filters, trials, reshaping, sampling and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.code import valid_syntax
from rankloom.functions.text import strip_ws
from rankloom.operators import aggregates as A
from rankloom.operators import dedup as D
from rankloom.operators import filters as FI
from rankloom.operators import joins as J
from rankloom.operators import ranking as R
from rankloom.operators import reshape as U
from rankloom.operators import sampling as S
from rankloom.operators import trials as TR
from rankloom.plans.config import DATASETS
from rankloom.plans.fixtures import SCORED, TRIALS, scored, trials
from rankloom.plans.ranking_queries import rounded
from rankloom.session import materialize, spread, table

STAGES = ["is_valid_syntax", "has_no_lint_errors", "e3s1t", "e3s3t", "e3s10t"]
KEY = ["task_id", "sid"]


def solutions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "solutions").filter("task_id is not null")


def dedup_max_logprob(spark, sf_dir):
    d = D.dedup_max_logprob(solutions(spark, sf_dir), ["task_id"], F.col("solution"), "solution_key", first=["source"])
    return d.select("task_id", "solution_key", "count", "logprob", "completion_id", "source")


def dedup_min_numeric(spark, sf_dir):
    d = solutions(spark, sf_dir).select("task_id", "solution_key", "solution", "num_tokens", "elapsed", "passed", "timed_out", "source")
    return D.dedup_min_numeric(d, ["task_id"], F.col("solution"), "solution_key").select("task_id", "solution_key", "dup_count", "num_tokens", "elapsed", "passed", "timed_out", "source")


def _split_syntax(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = D.merged_with_syntax(spread(solutions(spark, sf_dir)), ["task_id"], strip_ws(F.col("solution")), valid_syntax(F.col("text")), ["logprob", "num_tokens", "completion_id"])
    return D.split_valid(materialize(d, "parsed"))


def dedup_split_syntax(spark, sf_dir):
    """Merged programs of either side of the parser's split; SQL can't parse, so the twin has what both sides share."""
    ok, bad = _split_syntax(spark, sf_dir)
    return ok.unionByName(bad).select("task_id", F.md5("text").alias("text_md5"), "count", "logprob", "num_tokens", "completion_id")


def syntax_split(spark, sf_dir):
    """Per side of the split: programs, their weight, and passed ones, of which the invalid side has none."""
    ok, bad = _split_syntax(spark, sf_dir)
    d = ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return d.groupBy("valid").agg(F.count(F.lit(1)).alias("programs"), F.sum("count").alias("weight"), F.count_if("passed").alias("passed"))


def percent_unique(spark, sf_dir):
    return rounded(D.percent_unique(solutions(spark, sf_dir).filter("solution is not null"), ["task_id"], "solution"))


def dedup_total(spark, sf_dir):
    d = solutions(spark, sf_dir).filter("solution is not null")
    return D.total_preserved(d, D.dedup_max_logprob(d, ["task_id"], F.col("solution"), "solution_key"))


def _long_flags(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, STAGES)), F.pmod(F.col("trial"), F.lit(5)) + 1)
    return trials(spark, sf_dir).select("task_id", "sid", names.alias("filter_name"), "passed", "timeout")


def filter_pivot(spark, sf_dir):
    return TR.pivot_flags(_long_flags(spark, sf_dir), KEY, "filter_name", STAGES)


def _filtered(spark, sf_dir):
    c = scored(spark, sf_dir).withColumn("sid", F.col("sid").cast("string"))
    return FI.staged_filter(c, filter_pivot(spark, sf_dir), KEY, "is_valid_syntax", missing="prune")


def staged_filter_kept(spark, sf_dir):
    return FI.split_kept(_filtered(spark, sf_dir))[0].select("task_id", "sid", "score")


def staged_filter_pruned(spark, sf_dir):
    d = FI.split_kept(_filtered(spark, sf_dir))[1]
    return d.groupBy("task_id").agg(F.count(F.lit(1)).alias("pruned"))


def filter_then_rank(spark, sf_dir):
    d = FI.prune_scores(_filtered(spark, sf_dir)).withColumn("sid", F.col("sid").cast("int"))
    per = R.problem_metrics(R.rank_intervals(d, ["task_id"], flags=["passed"]), ["task_id"], ks=(4,))
    return rounded(R.macro_average(per, ["rs", "mrr", "top1", "b_of_4"]))


def mixed_outcomes(spark, sf_dir):
    return FI.mixed_outcomes(solutions(spark, sf_dir), ["task_id"])


def complete_groups(spark, sf_dir):
    d = solutions(spark, sf_dir).filter("model is not null and setup is not null and dataset is not null").select("model", "setup", "dataset").distinct()
    expected = spark.createDataFrame([(x,) for x in DATASETS], "dataset string")
    return FI.complete_groups(d, ["model", "setup"], "dataset", expected)


def trial_agg(spark, sf_dir):
    d = TR.flatten_timing(trials(spark, sf_dir)).withColumn("ord", F.struct("trial", "finished_at"))
    out = TR.aggregate_trials(d, KEY, "ord", ["num_ran", "num_passed", "return_code", "timeout"], ["execution_time", "writing_time"])
    return rounded(out, nudge=1e-9)


def trial_homogeneity(spark, sf_dir):
    return TR.agreement(trials(spark, sf_dir), KEY, "num_passed", "trial", "num_passed_vals")


def trial_collapse(spark, sf_dir):
    return TR.collapse_trials(trials(spark, sf_dir), KEY)


def stage_time(spark, sf_dir):
    d = TR.flatten_timing(trials(spark, sf_dir))
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    t = TR.wall_time(clean("execution_time"), clean("preprocess_time"), clean("postprocess_time"), clean("execution_time"), F.col("task_id").startswith("code_contests"))
    return rounded(d.groupBy("trial").agg(F.sum(t).alias("wall_time")), 4)


def pps_by_trial(spark, sf_dir):
    return rounded(TR.programs_per_second(TR.flatten_timing(trials(spark, sf_dir)), ["trial"], ["execution_time", "preprocess_time"]), 4)


def trial_totals(spark, sf_dir):
    return rounded(TR.trial_totals(trials(spark, sf_dir)))


def timing_lookup(spark, sf_dir):
    """The mean stage time of each cell of the grid of generators, setups, datasets and filters; null where it wasn't measured."""
    f = table(spark, sf_dir, "filter_timings_summary").filter("filter_name is not null and dataset is not null and not isnan(time)")
    return rounded(J.stage_times(f, ["generator", "sampling_setup", "dataset", "filter_name"]), 4)


def config_grid(spark, sf_dir):
    """All cells of models, setups and datasets, and whether they were sampled."""
    return J.config_grid(table(spark, sf_dir, "solutions"), ["model", "setup", "dataset"])


def problem_text_join(spark, sf_dir):
    """Candidates with the description of their problem: the record of smallest key, of whatever split."""
    p = table(spark, sf_dir, "problems").filter("task_id is not null")
    p = p.groupBy("task_id").agg(F.min_by("description", "problem_key").alias("problem"))
    d = J.with_problem_text(solutions(spark, sf_dir).select("solution_key", "task_id"), p, "task_id")
    return d.select("solution_key", F.length("problem").alias("problem_chars"))


def hot_text_join(spark, sf_dir):
    """The same with the heaviest problems' rows joined where they lie; only those of more than a 20th of all rows here."""
    p = table(spark, sf_dir, "problems").filter("task_id is not null")
    p = p.groupBy("task_id").agg(F.min_by("description", "problem_key").alias("problem"))
    d = J.with_hot_text(solutions(spark, sf_dir).select("solution_key", "task_id"), p, "task_id", most=20)
    return d.select("solution_key", F.length("problem").alias("problem_chars"))


def split_anti_join(spark, sf_dir):
    p = table(spark, sf_dir, "problems").filter("task_id is not null")
    return J.not_in(p.filter("split = 'train'"), p.filter("split in ('validation', 'test')"), "task_id").select("problem_key")


def pointwise_sample(spark, sf_dir):
    return S.pointwise_sample(solutions(spark, sf_dir).select("task_id", "solution_key", "passed"), "task_id", "solution_key", 3, 1)


def pairwise_sample(spark, sf_dir):
    return S.pairwise_sample(solutions(spark, sf_dir), "task_id", "solution_key", "passed", 6, 1)


def train_val_split(spark, sf_dir):
    pool = FI.mixed_outcomes(solutions(spark, sf_dir), ["task_id"]).select("task_id")
    val, train = S.validation_split(pool, "task_id", 0.1, 25, 7)
    return val.withColumn("part", F.lit("validation")).unionByName(train.withColumn("part", F.lit("train")))


def sample_rows(spark, sf_dir):
    return S.sample_rows(solutions(spark, sf_dir).select("solution_key"), "solution_key", 50, 2024)


def sample_with_replacement(spark, sf_dir):
    return S.sample_with_replacement(table(spark, sf_dir, "problems").select("problem_key"), "problem_key", 200, 1999)


def row_numbers(spark, sf_dir):
    return S.with_row_numbers(solutions(spark, sf_dir).select("solution_key"), ["solution_key"], "idx")


def head_tail(spark, sf_dir):
    return S.head_and_tail(table(spark, sf_dir, "problems").select("problem_key", "split"), ["problem_key"], 10)


def topk_longest(spark, sf_dir):
    return S.longest(solutions(spark, sf_dir).select("solution_key", F.length("solution").alias("chars")), F.coalesce("chars", F.lit(0)), "solution_key", 20)


def nested_roundtrip(spark, sf_dir):
    d = solutions(spark, sf_dir).select("task_id", "solution_key", "sid", "passed", "count")
    nested = U.renest(d, ["task_id"], ["solution_key", "sid", "passed", "count"], "solutions", "solution_key")
    return U.unnest(nested, "solutions", ["task_id"])


def positions(spark, sf_dir):
    d = solutions(spark, sf_dir).select("task_id", "solution_key", "passed")
    nested = U.renest(d, ["task_id"], ["solution_key", "passed"], "solutions", "solution_key")
    return U.unnest(nested.withColumn("solutions", U.with_positions(F.col("solutions"), "pos")), "solutions", ["task_id"])


def kept_arrays(spark, sf_dir):
    d = solutions(spark, sf_dir).select("task_id", "solution_key", "passed")
    nested = U.renest(d, ["task_id"], ["solution_key", "passed"], "s", "solution_key")
    kept, pruned = U.partition_array(F.col("s"), lambda x: x["passed"])
    return nested.select("task_id", F.size(kept).alias("kept"), F.size(pruned).alias("pruned"))


def zip_outcomes(spark, sf_dir):
    """Both kinds of outcomes side by side; where one has fewer tests, it ends in nulls."""
    return U.zipped(solutions(spark, sf_dir), {"outcomes": "base", "plus_outcomes": "plus"}, ["solution_key"], unequal="null")


def pair_scores(spark, sf_dir):
    d = U.paired_choices(scored(spark, sf_dir).select("task_id", "sid", R.effective_score(F.col("score")).alias("score")))
    d = d.withColumn("v", F.when(F.col("target") == 1, F.col("score")).otherwise(1 - F.col("score")))
    return rounded(U.repaired(d, KEY, "v"))


def source_counts(spark, sf_dir):
    return A.source_counts(solutions(spark, sf_dir), "source")


def pass_level_counts(spark, sf_dir):
    return A.pass_level_counts(solutions(spark, sf_dir), ["task_id"], ["passed", "passed_public", "passed_plus"])


def pair_statistics(spark, sf_dir):
    return rounded(A.pair_statistics(solutions(spark, sf_dir), ["task_id"], "passed"))


def problems_passing(spark, sf_dir):
    d = trials(spark, sf_dir)
    pub = F.col("passed_public")
    return A.problems_passing(d, ["task_id"], {"public": pub, "public_private": pub & F.col("passed_private"), "all_levels": pub & F.col("passed_private") & F.col("passed_generated")})


def token_length_stats(spark, sf_dir):
    return rounded(A.length_statistics(solutions(spark, sf_dir), F.col("num_tokens"), ["source"]))


def uniform_total(spark, sf_dir):
    return A.uniform_total(solutions(spark, sf_dir), ["task_id"], "count")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_max_logprob, dedup_min_numeric, dedup_split_syntax, syntax_split, percent_unique, dedup_total, filter_pivot, staged_filter_kept, staged_filter_pruned, filter_then_rank,
        mixed_outcomes, complete_groups, trial_agg, trial_homogeneity, trial_collapse, stage_time, pps_by_trial, trial_totals, timing_lookup, config_grid, problem_text_join, hot_text_join,
        split_anti_join, pointwise_sample, pairwise_sample, train_val_split, sample_rows, sample_with_replacement, row_numbers, head_tail, topk_longest, nested_roundtrip,
        positions, kept_arrays, zip_outcomes, pair_scores, source_counts, pass_level_counts, pair_statistics, problems_passing, token_length_stats, uniform_total,
    )
}

_S = "s as (select * from solutions where task_id is not null)"
_PIVOT = f"""{TRIALS}, long as (select task_id, sid, list_extract({STAGES!r}, (trial % 5) + 1) f, passed, timeout from trials),
flags as (select task_id, sid, {", ".join(f"bool_or(passed) filter (f = '{n}') {n}, bool_or(timeout) filter (f = '{n}') {n}_timeout" for n in STAGES)} from long group by 1, 2)"""
_KEEP = f"""{SCORED}, {_PIVOT}, kept as (select c.* exclude (sid), c.sid::varchar sid, coalesce(is_valid_syntax or coalesce(is_valid_syntax_timeout, false), false) keep
  from scored c left join flags f on f.task_id = c.task_id and f.sid = c.sid::varchar)"""
_MIXED = f"{_S}, pool as (select task_id, count(*) filter (passed) passing, count(*) total from s group by 1 having count(*) filter (passed) > 0 and count(*) filter (passed) < count(*))"
_T = "case when not isnan({0}) then {0} end"
_TIME = lambda n: f"case when not isnan(timing['{n}_time']) then timing['{n}_time'] end"

SQL = {
    "dedup_max_logprob": f"with {_S} select task_id, min(solution_key) solution_key, count(*) count, nullif(max(logprob), 0) logprob, min(completion_id) completion_id, arg_min_null(source, solution_key) source from s where solution is not null group by task_id, solution",
    "dedup_min_numeric": f"with {_S} select task_id, min(solution_key) solution_key, count(*) dup_count, min(num_tokens) num_tokens, min(elapsed) elapsed, bool_and(passed) passed, bool_and(timed_out) timed_out, arg_max_null(source, solution_key) source from s where solution is not null group by task_id, solution",
    "dedup_split_syntax": rf"""with {_S}, t as (select *, regexp_replace(solution, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') t from s where solution is not null)
select task_id, md5(t) text_md5, count(*) count, min(logprob) logprob, min(num_tokens) num_tokens, min(completion_id) completion_id from t group by task_id, t""",
    "percent_unique": f"with {_S}, p as (select task_id, count(*) r, count(distinct solution) u from s where solution is not null group by 1) select sum(r)::bigint as \"rows\", sum(u)::bigint unique_rows, round(sum(u) / sum(r), 6) pct_unique, round(avg(u), 6) mean_unique from p",
    "dedup_total": f"with {_S} select count(*) rows_before, count(*) count_after, true preserved from s where solution is not null",
    "filter_pivot": f"with {_PIVOT} select * from flags",
    "staged_filter_kept": f"with {_KEEP} select task_id, sid, score from kept where keep",
    "staged_filter_pruned": f"with {_KEEP} select task_id, count(*) pruned from kept where not keep group by 1",
    "mixed_outcomes": f"with {_MIXED} select * from pool",
    "complete_groups": "with d as (select distinct model, setup, dataset from solutions where model is not null and setup is not null and dataset is not null) select * from d where (model, setup) in (select (model, setup) from d where dataset in ('gsm8k', 'mbpp', 'code_contests', 'humaneval') group by model, setup having count(distinct dataset) = 4)",
    "trial_agg": f"""with {TRIALS}, d as (select *, {_TIME('execution')} ex, {_TIME('writing')} wr from trials)
select task_id, sid, count(*) trials, arg_min(num_ran, (trial, finished_at)) num_ran, arg_min(num_passed, (trial, finished_at)) num_passed, arg_min(return_code, (trial, finished_at)) return_code, arg_min(timeout, (trial, finished_at)) timeout,
round(avg(ex) + 1e-9, 6) execution_time, round(avg(wr) + 1e-9, 6) writing_time, round(stddev_samp(ex) + 1e-9, 6) execution_time_std, round(stddev_samp(wr) + 1e-9, 6) writing_time_std from d group by 1, 2""",
    "trial_homogeneity": f"""with {TRIALS}, p as (select task_id, sid, coalesce(num_passed::varchar, 'None') v, count(*) n, min(trial) t from trials group by 1, 2, 3)
select task_id, sid, case when count(*) > 1 then string_agg(v || ':' || n, '|' order by t, v) end num_passed_vals from p group by 1, 2""",
    "trial_collapse": f"with {TRIALS} select task_id, sid, bool_or(passed) passed, bool_or(timeout) timeout from trials group by 1, 2",
    "stage_time": f"with {TRIALS} select trial, round(sum(case when task_id like 'code_contests%' then ({_TIME('execution')}) + coalesce({_TIME('preprocess')}, 0) + coalesce({_TIME('postprocess')}, 0) else {_TIME('execution')} end), 4) wall_time from trials group by 1",
    "pps_by_trial": f"with {TRIALS} select trial, count(*) num_preds, round(count(*) / avg({_TIME('execution')}), 4) execution_pps, round(count(*) / avg({_TIME('preprocess')}), 4) preprocess_pps from trials group by 1",
    "trial_totals": f"with {TRIALS} select trial, count(*) filter (passed) programs_passed, count(*) num_preds, round(count(*) filter (passed) / count(*), 6) pct_passed from trials group by 1",
    "timing_lookup": "with f as (select * from filter_timings_summary where filter_name is not null and dataset is not null and not isnan(time) and generator is not null and sampling_setup is not null) select g.*, s.*, d.*, n.*, round((select avg(time) from f where generator = g.generator and sampling_setup = s.sampling_setup and dataset = d.dataset and filter_name = n.filter_name), 4) as \"time\" from (select distinct generator from f) g, (select distinct sampling_setup from f) s, (select distinct dataset from f) d, (select distinct filter_name from f) n",
    "config_grid": "with d as (select * from solutions where model is not null and setup is not null and dataset is not null) select *, (model, setup, dataset) in (select (model, setup, dataset) from d) \"exists\" from (select distinct model from d), (select distinct setup from d), (select distinct dataset from d)",
    "problem_text_join": f"with {_S}, p as (select task_id, arg_min_null(description, problem_key) problem from problems where task_id is not null group by 1) select solution_key, length(problem) problem_chars from s join p using (task_id)",
    "split_anti_join": "select problem_key from problems where split = 'train' and task_id is not null and task_id not in (select task_id from problems where split in ('validation', 'test') and task_id is not null)",
    "pointwise_sample": f"with {_S} select task_id, solution_key, passed from s qualify row_number() over (partition by task_id order by md5(concat_ws('|', task_id, solution_key, '1')), solution_key) <= 3",
    "pairwise_sample": f"""with {_S}, r as (select task_id, solution_key k, coalesce(passed, false) p, row_number() over (partition by task_id, coalesce(passed, false) order by md5(concat_ws('|', task_id, solution_key, '1')), solution_key) rn from s)
select a.task_id, a.rn, a.k chosen, b.k rejected from r a join r b on a.task_id = b.task_id and a.rn = b.rn and a.p and not b.p where a.rn <= 6""",
    "train_val_split": f"with {_MIXED}, n as (select least(ceil(count(*) * 0.1), 25) n from pool) select task_id, case when row_number() over (order by md5(concat_ws('|', task_id, '7')), task_id) <= (select n from n) then 'validation' else 'train' end part from pool",
    "sample_rows": f"with {_S} select solution_key from s order by md5(concat_ws('|', solution_key, '2024')), solution_key limit 50",
    "sample_with_replacement": """with o as (select problem_key, row_number() over (order by problem_key) - 1 i from problems),
d as (select i draw, ('0x' || md5(concat_ws('|', i, '1999'))[1:12])::bigint % (select count(*) from problems) pl from range(200) t(i)) select problem_key, draw from d join o on o.i = d.pl""",
    "row_numbers": f"with {_S} select solution_key, row_number() over (order by solution_key) - 1 idx from s",
    "head_tail": "select problem_key, split from (select *, row_number() over (order by problem_key) a, row_number() over (order by problem_key desc) b from problems) where a <= 5 or b <= 5",
    "topk_longest": f"with {_S} select solution_key, length(solution) chars from s order by coalesce(length(solution), 0) desc, solution_key limit 20",
    "nested_roundtrip": f"with {_S} select task_id, solution_key, sid, passed, count from s",
    "positions": f"with {_S} select task_id, solution_key, passed, (row_number() over (partition by task_id order by solution_key) - 1)::int pos from s",
    "kept_arrays": f"with {_S} select task_id, (count(*) filter (passed))::int kept, (count(*) filter (not coalesce(passed, false)))::int pruned from s group by 1",
    "zip_outcomes": f"with {_S} select solution_key, pos::int pos, outcomes[pos + 1] base, plus_outcomes[pos + 1] plus from (select *, unnest(range(greatest(coalesce(len(outcomes), 0), coalesce(len(plus_outcomes), 0)))) pos from s)",
    "pair_scores": f"with {SCORED} select task_id, sid, round(max(1 - e), 6) failed_score, round(max(e), 6) score from (select *, case when score is null or isnan(score) then '-infinity'::double else score end e from scored) group by 1, 2",
    "source_counts": f"with {_S} select source, count(*) n from s group by 1",
    "pass_level_counts": f"with {_S} select task_id, count(*) total, count(*) filter (passed) num_passed, count(*) filter (passed_public) num_passed_public, count(*) filter (passed_plus) num_passed_plus from s group by 1",
    "pair_statistics": f"""with {_S}, p as (select task_id, count(*) filter (passed) passes, least(count(*) filter (passed), count(*) filter (not coalesce(passed, false))) pairs from s group by 1)
select count(*) problems, round(avg((passes > 0)::int), 6) with_passes, round(avg(passes), 6) mean_passes, round(stddev_pop(passes), 6) std_passes, round(avg((pairs > 0)::int), 6) with_pairs, round(avg(pairs), 6) mean_pairs, round(stddev_pop(pairs), 6) std_pairs from p""",
    "problems_passing": f"with {TRIALS}, p as (select task_id, coalesce(bool_or(passed_public), false) a, coalesce(bool_or(passed_public and passed_private), false) b, coalesce(bool_or(passed_public and passed_private and passed_generated), false) c from trials group by 1) select count(*) problems, count(*) filter (a) public, count(*) filter (b) public_private, count(*) filter (c) all_levels from p",
    "token_length_stats": f"with {_S} select source, sum(num_tokens)::bigint total, max(num_tokens) longest, round(avg(num_tokens), 6) mean, round(stddev_pop(num_tokens), 6) std from s group by 1",
    "uniform_total": f"with {_S}, t as (select sum(coalesce(count, 1))::bigint t from s group by task_id) select count(distinct t) totals, min(t) least, max(t) largest from t",
}
SQL["filter_then_rank"] = (
    f"with {_KEEP}, e as (select *, case when keep and score is not null and not isnan(score) then score else '-infinity'::double end eff, greatest(coalesce(count, 1), 1) w from kept), "
    "r as (select *, sum(w) over (partition by task_id order by eff desc, sid::int rows unbounded preceding) hi from e), "
    "x as (select task_id, coalesce(passed, false) p, unnest(range((hi - w)::bigint, hi::bigint)) i from r), "
    "n as (select *, count(*) over (partition by task_id) n, count(*) filter (p) over (partition by task_id) r from x), "
    "m as (select task_id, case when max(r) <= 1 then 0 else count(*) filter (p and i < r) / max(r)::double end rs, coalesce(1.0 / (min(i) filter (p) + 1), 0)::double mrr, (bool_or(p and i = 0))::int top1, "
    "coalesce(sum((n - i - 1.0) * (n - i - 2) * (n - i - 3) / 6 / (n::double * (n - 1) * (n - 2) * (n - 3) / 24)) filter (p and i < n - 4 and n >= 4), 0) b_of_4 from n group by 1) "
    "select count(*) problems, round(avg(rs), 6) rs, round(avg(mrr), 6) mrr, round(avg(top1), 6) top1, round(avg(b_of_4), 6) b_of_4 from m"
)
SQL["hot_text_join"] = SQL["problem_text_join"]
