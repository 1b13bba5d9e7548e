"""Queries over text, template, code, array and scoring functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import arrays as A
from rankloom.functions import code as C
from rankloom.functions import templates as T
from rankloom.functions import text as X
from rankloom.operators import batching as B
from rankloom.operators import filters as FI
from rankloom.operators import projections as P
from rankloom.operators import reshape as U
from rankloom.operators import scoring as SC
from rankloom.operators.aggregates import import_counts as count_imports
from rankloom.operators.aggregates import passed_at, percentile_columns, throughput
from rankloom.plans.config import SUITES
from rankloom.plans.fixtures import RANKED, TRIALS, scored, trials
from rankloom.plans.ranking_queries import _metrics, rounded
from rankloom.plans.relational_queries import solutions
from rankloom.plans.suite import run_suite, suite_report
from rankloom.session import spread, table


def fence_strip(spark, sf_dir):
    return solutions(spark, sf_dir).select("solution_key", F.md5(X.before_fence(F.col("solution"))).alias("h"))


def whitespace_strip(spark, sf_dir):
    return solutions(spark, sf_dir).select("solution_key", F.length(X.strip_ws(F.col("solution"))).alias("chars"), F.length(X.rstrip_ws(F.col("solution"))).alias("rchars"))


def program_postprocess(spark, sf_dir):
    return solutions(spark, sf_dir).select("solution_key", F.md5(X.as_program(F.col("solution"), True)).alias("h"))


def lint_parse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    r = X.lint_report(F.col("text"))
    return d.select("doc_id", *[c.alias(n) for n, c in r.items()])


def model_sizes(spark, sf_dir):
    return table(spark, sf_dir, "problems").groupBy("model").agg(F.max(X.model_parameters(F.col("model"))).alias("parameters"))


def clock_times(spark, sf_dir):
    d = table(spark, sf_dir, "filter_timings_summary").filter("time is not null and not isnan(time)")
    return d.select("generator", "filter_name", "finished_at", X.clock(F.round("time", 2)).alias("clock"))


def path_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("url is not null")
    return d.select("doc_id", X.file_task(F.col("url")).alias("task"), X.file_shard(F.col("url")).alias("shard"))


def prompt_render(spark, sf_dir):
    t = T.TEMPLATES["qsol_task"]
    p = table(spark, sf_dir, "problems").filter("task_id is not null").groupBy("task_id").agg(F.min_by("description", "problem_key").alias("problem"))
    d = solutions(spark, sf_dir).filter("solution is not null").join(p, "task_id", "left")
    return d.select("solution_key", F.md5(T.prompt(t, F.col("problem"), F.col("solution"), newline=True)).alias("h"), T.completion(t, F.coalesce("passed", F.lit(False))).alias("completion"))


def icl_render(spark, sf_dir):
    t = T.TEMPLATES["base"]
    shots = [T.example(t, "Add two.", "print(1 + 1)", True), T.example(t, "", "print(2)", False)]
    d = solutions(spark, sf_dir).filter("solution is not null")
    return d.select("solution_key", F.md5(T.prompt(t, F.col("task_id"), F.col("solution"), examples=shots)).alias("h"))


def chat_render(spark, sf_dir):
    d = solutions(spark, sf_dir).filter("solution is not null")
    turns = T.chat(F.col("task_id"), "Be brief.", F.col("solution"), [("q", "a")])
    asked, answer = T.split_at_last_user(turns)
    return d.select("solution_key", F.md5(T.rendered_chat(turns)).alias("h"), F.size(asked).alias("asked"), F.length(answer).alias("answer_chars"))


def dummy_prefix(spark, sf_dir):
    t = T.TEMPLATES["qsol_task"]
    d = table(spark, sf_dir, "problems")
    return d.select("problem_key", F.md5(T.prefix(t, F.col("description"))).alias("h"))


def preference_suffixes(spark, sf_dir):
    """Chosen and rejected texts without the prompt that both begin with."""
    t = T.TEMPLATES["raw_yn"]
    d = solutions(spark, sf_dir).filter("solution is not null")
    pre = T.prefix(t, F.col("task_id"))
    return d.select("solution_key", (X.after_prefix(T.prompt(t, F.col("task_id"), F.col("solution")), pre) == F.col("solution")).alias("same"))


def json_fields(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return d.select("event_id", "p.k", F.to_json(F.struct(F.col("p.k").alias("k"))).alias("again"))


def private_ladder(spark, sf_dir):
    types = F.when(F.pmod("trial", F.lit(3)) == 0, F.array(F.lit(0), F.lit(1))).when(F.pmod("trial", F.lit(3)) == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    d = trials(spark, sf_dir).select("trial", "task_id", "sid", P.private_ladder(types, F.col("passed_private"), F.col("passed_generated"), F.col("passed")).alias("private"))
    return d.groupBy("trial").agg(F.count_if("private").alias("passing"), F.count(F.lit(1)).alias("n"))


def status_decode(spark, sf_dir):
    d = solutions(spark, sf_dir)
    word = lambda c: F.when(F.col(c).isNull(), None).when(F.col("timed_out"), P.TIMEOUT).when(F.col(c), P.PASS).otherwise(P.FAIL)
    r = P.decode_status(word("passed_public"), word("passed_plus"), F.col("outcomes"), F.col("plus_outcomes"))
    return d.select("solution_key", r["passed"].alias("passed"), r["timeout"].alias("late"), F.size(r["outcomes"]).alias("tests"))


def completed_outcomes(spark, sf_dir):
    d = P.completed_outcomes(solutions(spark, sf_dir).select("solution_key", "passed", "passed_plus", "outcomes", "plus_outcomes"))
    return d.select("solution_key", "num_tests_passed", F.size("outcomes").alias("base"), F.size("plus_outcomes").alias("plus"))


def share_passed(spark, sf_dir):
    return rounded(solutions(spark, sf_dir).select("solution_key", P.share_passed(F.col("outcomes")).alias("share")))


def trial_elapsed(spark, sf_dir):
    e = P.elapsed(F.col("timing"))
    return rounded(trials(spark, sf_dir).groupBy("trial").agg(F.sum(F.when(~F.isnan(e), e)).alias("elapsed")), 4)


def problem_keep(spark, sf_dir):
    return FI.usable_problems(solutions(spark, sf_dir).filter("solution is not null"), ["task_id"], "solution")


def problem_keep_nested(spark, sf_dir):
    """The same over records with their programs in an array."""
    d = solutions(spark, sf_dir).filter("solution is not null").select("task_id", "solution_key", F.col("solution").alias("code"), "passed")
    nested = U.renest(d, ["task_id"], ["code", "passed"], "predictions", "solution_key")
    keep = FI.usable_problem(F.col("predictions"), F.array().cast("array<struct<code:string,passed:boolean>>"))
    return nested.select("task_id", keep.alias("keep"))


def stopped_samples(spark, sf_dir):
    """Samples up to the first stop word."""
    return solutions(spark, sf_dir).select("solution_key", F.length(X.before_stops(F.col("solution"), ["\nif __name__", "\nprint("])).alias("chars"))


def time_percentiles(spark, sf_dir):
    return rounded(percentile_columns(table(spark, sf_dir, "filter_timings_summary"), ["filter_name"], "time", (5, 50, 95)), 5)


def passed_at_two(spark, sf_dir):
    return passed_at(solutions(spark, sf_dir).filter("outcomes is not null"), ["task_id"], F.col("outcomes"), 2)


def left_truncate(spark, sf_dir):
    d = solutions(spark, sf_dir)
    return d.select("solution_key", F.array_join(F.transform(A.keep_last(F.col("outcomes"), 3), lambda x: x.cast("string")), ",").alias("last"))


def pad_to_longest(spark, sf_dir):
    d = solutions(spark, sf_dir).select("solution_key", "source", F.transform("outcomes", lambda x: x.cast("int")).alias("ids"))
    out = A.pad_batches(d.filter("ids is not null and source is not null"), "source", {"ids": -1}, left=True)
    return out.select("solution_key", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0), lambda a, x: a + x).alias("total"))


def token_specials(spark, sf_dir):
    d = solutions(spark, sf_dir).filter("outcomes is not null").select("solution_key", F.transform("outcomes", lambda x: x.cast("int")).alias("ids"))
    ids = A.with_specials(F.col("ids"), bos=1, eos=2)
    return d.select("solution_key", F.size(ids).alias("n"), F.size(A.labels(ids, F.col("ids"))).alias("labels"))


def logsoftmax_gather(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), "label")
    return rounded(d.select("vec_id", A.log_softmax_at(F.col("e"), F.col("label")).alias("logprob"), A.argmax(F.col("e")).alias("argmax")))


def binary_scores(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), "label")
    d = SC.binary(d, F.slice("e", 1, 4), F.slice("e", 5, 4), F.array(F.lit(1), F.lit(1), F.lit(0), F.lit(1)))
    d = SC.losses(d, F.col("score"), F.col("failed_score"), F.col("label") > 4)
    return rounded(d.select("vec_id", "score", "failed_score", "pred", "point_loss", "pair_loss", SC.pair_loss(F.col("score"), F.col("failed_score")).alias("rank_loss")))


def mean_logprob(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rounded(SC.mean_logprob(d, F.col("e"), F.transform("e", lambda x, i: (i >= 10).cast("int"))).select("vec_id", "score"))


def batch_pack(spark, sf_dir):
    d = solutions(spark, sf_dir).filter("num_tokens is not null").select("solution_key", F.col("num_tokens").cast("bigint").alias("num_tokens"))
    out = B.packed(d, "num_tokens", "solution_key", 4096, 8, partitions=1)
    return out.select("solution_key", "batch")


def batch_pack_parts(spark, sf_dir):
    """The distributed form of ``batch_pack``: parts of the order of lengths, each packed by a task of its own."""
    d = solutions(spark, sf_dir).filter("num_tokens is not null").select("solution_key", F.col("num_tokens").cast("bigint").alias("num_tokens"))
    return B.packed(d, "num_tokens", "solution_key", 4096, 8).select("solution_key", "num_tokens", "part", "batch")


def batch_estimate(spark, sf_dir):
    return B.estimated_batches(solutions(spark, sf_dir), F.col("num_tokens"), 4096)


def syntax_validity(spark, sf_dir):
    d = spread(solutions(spark, sf_dir).filter("solution is not null").select("solution_key", "solution", "passed", "count"))
    return d.select("solution_key", C.valid_syntax(F.col("solution")).alias("valid"))


def import_counts(spark, sf_dir):
    d = spread(solutions(spark, sf_dir).filter("solution is not null").select("solution_key", "solution", "passed", "count"))
    return count_imports(d, C.imports(F.col("solution")), F.coalesce("count", F.lit(1)), F.coalesce("passed", F.lit(False)))


def docstrings(spark, sf_dir):
    d = spread(solutions(spark, sf_dir).filter("solution is not null").select("solution_key", "solution", "passed", "count"))
    return d.select("solution_key", C.docstring(F.col("solution")).alias("doc")).filter("doc is not null")


def comment_free(spark, sf_dir):
    d = spread(solutions(spark, sf_dir).filter("solution is not null").select("solution_key", "solution", "passed", "count"))
    return d.select("solution_key", C.clean_code(F.col("solution")).alias("clean"))


def suite_zero_shot(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("dataset", F.substring_index("task_id", "/", 1))
    s = SUITES["zero_shot"]
    return rounded(suite_report(run_suite(d, None, s), s))


def suite_throughput(spark, sf_dir):
    f = table(spark, sf_dir, "filter_timings_summary").filter("dataset is not null and time is not null and not isnan(time)")
    per = f.groupBy("dataset").agg(F.avg("time").alias("filtering"), F.count(F.lit(1)).alias("total_programs")).withColumn("scoring_function", F.col("filtering") * 2)
    return rounded(throughput(per, ["filtering", "scoring_function"]), 5)


QUERIES = {
    f.__name__: f
    for f in (
        fence_strip, whitespace_strip, program_postprocess, lint_parse, model_sizes, clock_times, path_parts, prompt_render, icl_render, chat_render, dummy_prefix, preference_suffixes, json_fields,
        private_ladder, status_decode, completed_outcomes, share_passed, trial_elapsed, problem_keep, problem_keep_nested, stopped_samples, time_percentiles, passed_at_two, left_truncate, pad_to_longest, token_specials, logsoftmax_gather, binary_scores, mean_logprob,
        batch_pack, batch_pack_parts, batch_estimate, syntax_validity, import_counts, docstrings, comment_free, suite_zero_shot, suite_throughput,
    )
}

_S = "s as (select * from solutions where task_id is not null)"
_F = "chr(96)||chr(96)||chr(96)"
_NL = "chr(10)"
_WS = r"[\s\x0b]+"
_P = "p as (select task_id, arg_min_null(description, problem_key) problem from problems where task_id is not null group by 1)"
_E = "e as (select vec_id, list_transform(embedding, lambda x: x::double) e, label from embeddings)"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g')"


_QSOL = f"'# Proposed Solution' || {_NL} || {_F} || 'python' || {_NL} || solution || {_NL} || {_F} || {_NL}"

SQL = {
    "fence_strip": f"with {_S} select solution_key, md5(split_part(solution, {_NL} || {_F}, 1)) h from s",
    "whitespace_strip": rf"with {_S} select solution_key, length({_strip('solution')}) chars, length(regexp_replace(solution, '{_WS}$', '')) rchars from s",
    "program_postprocess": rf"""with {_S}, a as (select solution_key, replace(regexp_replace(solution, '{_WS}$', ''), chr(13), '') t from s),
b as (select solution_key, {_strip(f"case when contains(t, {_F} || 'python') then substring(t, position({_F} || 'python' in t) + 9) else t end")} t from a) select solution_key, md5(split_part(t, {_NL} || {_F} || {_NL}, 1)) h from b""",
    "lint_parse": "select doc_id, try_cast(nullif(regexp_extract(text, 'rated at (\\d+\\.\\d+)/10', 1), '') as double) score, "
    + ", ".join(f"len(regexp_extract_all(text, ':[0-9]+:[0-9]+: {k}[0-9]+:'))::int {n}" for n, k in (("errors", "E"), ("warnings", "W"), ("conventions", "C"), ("refactors", "R"), ("fatals", "F")))
    + " from documents where text is not null",
    "model_sizes": "select model, max(case when regexp_matches(model, '[0-9]b$') then replace(regexp_extract(model, '(\\d+(_\\d+)?)b$', 1), '_', '.')::double * 1e9 when regexp_matches(model, '[0-9]m$') then regexp_extract(model, '(\\d+)m$', 1)::double * 1e6 end) parameters from problems group by 1",
    "clock_times": "with d as (select *, round(time, 2) t from filter_timings_summary where time is not null and not isnan(time)) select generator, filter_name, finished_at, printf('%02d:%02d:%05.2f', (floor(t)::bigint // 3600), (floor(t)::bigint % 3600) // 60, t - floor(floor(t) / 60) * 60) clock from d",
    "path_parts": "select doc_id, regexp_extract(split_part(url, '/', -1), '^(.*?)(?:\\.raw|_exec|\\.|$)', 1) task, try_cast(nullif(regexp_extract(url, '(\\d+)(?:\\.[a-z]+)*$', 1), '') as int) shard from documents where url is not null",
    "prompt_render": f"""with {_S}, {_P} select solution_key, md5(case when length(coalesce(problem, '')) > 0 then '# Question' || {_NL} || problem || {_NL} || {_NL} else {_NL} end || {_QSOL}) h,
{_NL} || '# Is the solution correct (Answer [Yes]/[No])?' || {_NL} || case when passed then '[Yes]' else '[No]' end completion from s left join p using (task_id) where solution is not null""",
    "icl_render": f"""with {_S} select solution_key, md5('# Example 1:' || {_NL} || {_F} || 'python' || {_NL} || '\"\"\"' || {_NL} || 'Add two.' || {_NL} || '\"\"\"' || {_NL} || 'print(1 + 1)' || {_NL} || {_F} || '# Is the solution correct (Answer Yes/No)?Yes' || {_NL} || {_NL}
|| '# Example 2:' || {_NL} || {_F} || 'python' || {_NL} || 'print(2)' || {_NL} || {_F} || '# Is the solution correct (Answer Yes/No)?No' || {_NL} || {_NL} || '# Example 3:' || {_NL}
|| {_F} || 'python' || {_NL} || case when length(task_id) > 0 then '\"\"\"' || {_NL} || task_id || {_NL} || '\"\"\"' || {_NL} else '' end || solution || {_NL} || {_F}) h from s where solution is not null""",
    "chat_render": f"""with {_S} select solution_key, md5('<|system|>' || {_NL} || 'Be brief.<|end|>' || {_NL} || '<|user|>' || {_NL} || 'q<|end|>' || {_NL} || '<|assistant|>' || {_NL} || 'a<|end|>' || {_NL} || '<|user|>' || {_NL} || task_id || '<|end|>' || {_NL} || '<|assistant|>' || {_NL} || solution || '<|end|>' || {_NL}) h,
4 asked, length(solution)::int answer_chars from s where solution is not null""",
    "dummy_prefix": f"select problem_key, md5(case when length(coalesce(description, '')) > 0 then '# Question' || {_NL} || description || {_NL} || {_NL} else {_NL} end || '# Proposed Solution' || {_NL} || {_F} || 'python' || {_NL}) h from problems",
    "preference_suffixes": f"with {_S} select solution_key, true same from s where solution is not null",
    "json_fields": "select event_id, (props->>'$.k')::bigint k, '{\"k\":' || (props->>'$.k') || '}' again from events",
    "private_ladder": f"with {TRIALS} select trial, count(*) filter (case trial % 3 when 0 then passed_private when 1 then passed_generated else passed end) passing, count(*) n from trials group by 1",
    "status_decode": f"""with {_S}, w as (select *, case when passed_public is null then null when timed_out then 'timeout' when passed_public then 'pass' else 'fail' end b, case when passed_plus is null then null when timed_out then 'timeout' when passed_plus then 'pass' else 'fail' end p from s)
select solution_key, (b is not null or p is not null) and coalesce(b = 'pass', true) and coalesce(p = 'pass', true) passed, coalesce(b = 'timeout', false) or coalesce(p = 'timeout', false) late, (coalesce(len(plus_outcomes), 0) + coalesce(len(outcomes), 0))::int tests from w""",
    "completed_outcomes": f"""with {_S} select solution_key, (case when coalesce(len(outcomes), 0) = 0 then coalesce(passed, false)::int else len(list_filter(outcomes, lambda x: x)) end + case when coalesce(len(plus_outcomes), 0) = 0 then 0 else len(list_filter(plus_outcomes, lambda x: x)) end)::int num_tests_passed,
greatest(coalesce(len(outcomes), 0), 1)::int base, greatest(coalesce(len(plus_outcomes), 0), 1)::int plus from s""",
    "share_passed": f"with {_S} select solution_key, round(coalesce(len(list_filter(outcomes, lambda x: x)) / nullif(len(outcomes), 0), 0), 6) share from s",
    "trial_elapsed": f"with {TRIALS}, e as (select trial, timing['execution_time'] + coalesce(timing['preprocess_time'], 0) + coalesce(timing['postprocess_time'], 0) e from trials) select trial, round(sum(e) filter (not isnan(e)), 4) elapsed from e group by 1",
    "problem_keep": f"with {_S} select task_id, coalesce(bool_or(passed) filter (length(solution) < 10000), false) and coalesce(bool_or(not coalesce(passed, false)) filter (length(solution) < 10000), false) keep from s where solution is not null group by 1",
    "stopped_samples": f"with {_S} select solution_key, length(split_part(split_part(solution, chr(10) || 'if __name__', 1), chr(10) || 'print(', 1)) chars from s",
    "time_percentiles": "select filter_name, " + ", ".join(f"round(quantile_cont(time, {p / 100}) filter (not isnan(time)), 5) percentile_{p:02d}" for p in (5, 50, 95)) + " from filter_timings_summary group by 1",
    "passed_at_two": f"with {_S} select task_id, bool_and(coalesce(list_bool_and(outcomes[1:2]), true)) passed_at_2 from s where outcomes is not null group by 1",
    "left_truncate": f"with {_S} select solution_key, array_to_string(outcomes[greatest(len(outcomes) - 2, 1):], ',') \"last\" from s",
    "pad_to_longest": f"with {_S}, d as (select solution_key, source, list_transform(outcomes, lambda x: x::int) ids from s where outcomes is not null and source is not null), m as (select source, max(len(ids)) m from d group by 1) select solution_key, m::int n, (coalesce(list_sum(ids), 0) - (m - len(ids)))::int total from d join m using (source)",
    "token_specials": f"with {_S}, d as (select solution_key, list_transform(outcomes, lambda x: x::int) ids from s where outcomes is not null), n as (select *, len(ids) + (coalesce(ids[1], -1) <> 1)::int + 1 n from d) select solution_key, n::int n, (n + len(ids))::int labels from n",
    "logsoftmax_gather": f"with {_E}, m as (select *, list_max(e) m from e) select vec_id, round(e[label + 1] - (m + ln(list_sum(list_transform(e, lambda x: exp(x - m))))), 6) logprob, (list_position(e, m) - 1)::int argmax from m",
    "binary_scores": f"""with {_E}, s as (select vec_id, (e[1] + e[2] + e[4]) / 3 a, (e[5] + e[6] + e[8]) / 3 b, label > 4 ok from e)
select vec_id, round(a, 6) score, round(b, 6) failed_score, a > b pred, round(ln(exp(a) + exp(b)) - case when ok then a else b end, 6) point_loss, round(case when ok then b - a else a - b end, 6) pair_loss, round(ln(1 + exp(b - a)), 6) rank_loss from s""",
    "mean_logprob": f"with {_E} select vec_id, round(list_avg(e[11:]), 6) score from e",
    "batch_pack": f"""with recursive {_S}, o as (select solution_key, num_tokens::bigint n, row_number() over (order by num_tokens desc, solution_key) - 1 rn from s where num_tokens is not null),
b as (select 0::bigint batch, 0::bigint a union all select b.batch + 1, b.a + greatest(1, 4096 // (n + 8 - n % 8)) from b join o on o.rn = b.a)
select solution_key, batch from o asof join b on o.rn >= b.a""",
    "batch_estimate": f"with {_S} select ceil(sum(num_tokens) / 4096)::bigint batches from s",
    "suite_zero_shot": f"""with {RANKED}, m as ({_metrics('passed', (4, 16, 64))}), c as (select task_id, eff, sum(w) c, count(*) u from iv group by 1, 2),
a as (select split_part(task_id, '/', 1) dataset, count(*)::double problems, 100 * avg(rs) rs, 100 * avg(mrr) mrr, 100 * avg(top1) top1, 100 * avg(b_of_4) b_of_4, 100 * avg(b_of_16) b_of_16, 100 * avg(b_of_64) b_of_64 from m group by 1),
b as (select split_part(task_id, '/', 1) dataset, (count(*) filter (c > 1))::double num_collisions, sum(u)::double unique_preds, 100 * (count(*) filter (c > 1)) / sum(u)::double pct_collisions, 0::double pruned from c group by 1),
w as (select * from a join b using (dataset)) select dataset, metric, round(v, 6) "value" from (unpivot w on columns(* exclude (dataset)) into name metric value v)""",
    "suite_throughput": "with p as (select dataset, avg(time) filtering, count(*) total_programs from filter_timings_summary where dataset is not null and not isnan(time) group by 1) select dataset, round(filtering, 5) filtering, total_programs, round(2 * filtering, 5) scoring_function, round(total_programs / filtering, 5) filtering_pps, round(total_programs / (2 * filtering), 5) scoring_function_pps, round(total_programs / (3 * filtering), 5) filter_and_score_pps from p",
}

SQL["problem_keep_nested"] = SQL["problem_keep"]
