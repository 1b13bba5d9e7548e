"""Queries that build training and validation sets, on ``solutions`` and ``problems``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import ranking as R
from rankloom.operators import tokenize as K
from rankloom.plans import training as TR
from rankloom.plans.config import DataConfig
from rankloom.plans.ranking_queries import rounded
from rankloom.plans.relational_queries import solutions
from rankloom.session import spread, table

CFG = DataConfig(examples_per_problem=4)


def _candidates(spark, sf_dir):
    p = table(spark, sf_dir, "problems").filter("task_id is not null").groupBy("task_id").agg(F.min_by("description", "problem_key").alias("problem"))
    d = solutions(spark, sf_dir).drop("sid").withColumnRenamed("solution_key", "sid")
    return d.join(p, "task_id", "left")


def train_pointwise(spark, sf_dir):
    d = TR.pointwise(_candidates(spark, sf_dir), CFG)
    return d.select("task_id", "sid", F.md5("query").alias("query_md5"), "completion", "passed")


def train_pairwise(spark, sf_dir):
    d = TR.pairwise(_candidates(spark, sf_dir), CFG)
    return d.select("task_id", "rn", F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


def validation_rows(spark, sf_dir):
    d = TR.validation_rows(_candidates(spark, sf_dir), 2)
    return d.select("idx", F.md5("query").alias("query_md5"), F.length("problem_dummy").alias("dummy_chars"), "passed")


def validation_ranking(spark, sf_dir):
    """Ranking by log-probability, at equal ones by index: R-precision, and best of 8, over all and over public outcomes."""
    d = solutions(spark, sf_dir).withColumn("score", F.col("logprob"))
    r = R.rank_intervals(d, ["task_id"], sid="solution_key", count=None, flags=["passed", "passed_public"])
    a = R.macro_average(R.problem_metrics(r, ["task_id"], "passed", (8,)), ["rs", "b_of_8"])
    b = R.macro_average(R.problem_metrics(r, ["task_id"], "passed_public", (8,)), ["rs", "b_of_8"]).toDF("public_problems", "public_rs", "public_b_of_8")
    return rounded(a.crossJoin(b))


def causal_tokens(spark, sf_dir):
    d = solutions(spark, sf_dir).filter("solution is not null").select("solution_key", "task_id", "solution")
    d = K.token_ids(K.token_ids(d, "task_id", "p"), "solution", "c")
    d = K.causal_rows(d, "p", "c", 256, 257, 512)
    ignored = F.size(F.filter("labels", lambda x: x == -100))
    return d.select("solution_key", F.size("input_ids").alias("n"), ignored.alias("ignored"), F.element_at("input_ids", 1).alias("first_id"))


def short_problems(spark, sf_dir):
    d = table(spark, sf_dir, "problems").filter("description is not null")
    return d.select("problem_key", F.md5(K.truncated_text(F.col("description"), 120)).alias("h"))


def syntax_trials(spark, sf_dir):
    d = spread(solutions(spark, sf_dir).select("task_id", F.col("solution_key").alias("sid"), "solution"))
    return TR.syntax_trials(d, 2)


def cleaned_programs(spark, sf_dir):
    d = spread(solutions(spark, sf_dir).filter("solution is not null").select("solution_key", "solution"))
    return TR.cleaned_programs(d, "solution").select("solution_key", F.length("solution").alias("chars"))


def latest_setup(spark, sf_dir):
    return TR.latest_checkpoint(table(spark, sf_dir, "problems").select("setup"), "setup")


QUERIES = {f.__name__: f for f in (train_pointwise, train_pairwise, validation_rows, validation_ranking, causal_tokens, short_problems, syntax_trials, cleaned_programs, latest_setup)}

_F = "chr(96)||chr(96)||chr(96)"
_NL = "chr(10)"
_C = "p as (select task_id, arg_min_null(description, problem_key) problem from problems where task_id is not null group by 1), c as (select s.*, problem from solutions s left join p using (task_id) where s.task_id is not null and solution is not null)"
_PRE = f"case when length(coalesce(problem, '')) > 0 then '# Question' || {_NL} || problem || {_NL} || {_NL} else {_NL} end || '# Proposed Solution' || {_NL} || {_F} || 'python' || {_NL}"


def _ranked(p: str) -> str:
    return f"""select avg(rs) rs, avg(b) b, count(*) n from (select task_id, case when max(r) <= 1 then 0 else count(*) filter (coalesce({p}, false) and i < r) / max(r)::double end rs,
coalesce(sum(exp((lgamma(n - i + 0.0) - lgamma(8.0) - lgamma(n - i - 7.0)) - (lgamma(n + 1.0) - lgamma(9.0) - lgamma(n - 7.0)))) filter (coalesce({p}, false) and i < n - 8 and n >= 8), 0) b
from (select *, count(*) over (partition by task_id) n, count(*) filter (coalesce({p}, false)) over (partition by task_id) r from o) group by 1)"""


SQL = {
    "train_pointwise": f"""with {_C}, r as (select *, row_number() over (partition by task_id order by md5(concat_ws('|', task_id, solution_key, '1')), solution_key) rn from c where length(solution) <= 10000)
select task_id, solution_key sid, md5({_PRE} || solution || {_NL} || {_F} || {_NL}) query_md5, {_NL} || '# Is the solution correct (Answer [Yes]/[No])?' || {_NL} || case when passed then '[Yes]' else '[No]' end completion, coalesce(passed, false) passed from r where rn <= 4""",
    "train_pairwise": f"""with {_C}, r as (select *, coalesce(passed, false) p, row_number() over (partition by task_id, coalesce(passed, false) order by md5(concat_ws('|', task_id, solution_key, '1')), solution_key) rn from c where length(solution) <= 10000)
select a.task_id, a.rn, md5({_PRE.replace('problem', 'a.problem')}) prompt_md5, md5(a.solution || {_NL} || {_F}) chosen_md5, md5(b.solution || {_NL} || {_F}) rejected_md5 from r a join r b on a.task_id = b.task_id and a.rn = b.rn and a.p and not b.p where a.rn <= 4""",
    "validation_rows": f"""with {_C}, r as (select *, row_number() over (partition by task_id order by solution_key) rn from c)
select task_id || '/' || solution_key idx, md5({_PRE} || solution || {_NL} || {_F} || {_NL}) query_md5, length({_PRE})::int dummy_chars, passed from r where rn <= 2""",
    "validation_ranking": f"""with o as (select *, row_number() over (partition by task_id order by coalesce(case when not isnan(logprob) then logprob end, '-infinity'::double) desc, solution_key) - 1 i from solutions where task_id is not null),
a as ({_ranked('passed')}), b as ({_ranked('passed_public')}) select a.n problems, round(a.rs, 6) rs, round(a.b, 6) b_of_8, b.n public_problems, round(b.rs, 6) public_rs, round(b.b, 6) public_b_of_8 from a, b""",
    "causal_tokens": """with d as (select solution_key, octet_length(encode(task_id)) p, octet_length(encode(solution)) c, ascii(task_id) a, solution s, task_id t from solutions where task_id is not null and solution is not null)
select solution_key, least(p + c + 2, 512)::int n, greatest(p + 1 - greatest(p + c + 2 - 512, 0), 0)::int ignored,
case when p + c + 2 <= 512 then 256 else ('0x' || substring(hex(encode(t || s)), (p + c + 1 - 511) * 2 - 1, 2))::int end first_id from d""",
    "latest_setup": "select setup from problems where setup is not null order by try_cast(nullif(regexp_extract(setup, '(\\d+)$', 1), '') as bigint) desc nulls last, setup desc limit 1",
    "short_problems": "select problem_key, md5(substring(description, 1, (select max(i) from range(0, 121) r(i) where octet_length(encode(substring(description, 1, i))) <= 120)::int)) h from problems where description is not null",
}
