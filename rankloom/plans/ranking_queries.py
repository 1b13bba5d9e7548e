"""Queries over the ranking operators, on ``scored_solutions`` and ``solutions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import ranking as R
from rankloom.plans.fixtures import RANKED, SCORED, scored
from rankloom.session import table

T = ["task_id"]


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, so that two engines' sums compare; ``nudge`` moves means of short decimals off the ties."""
    return df.select(*[F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ranked(spark: SparkSession, sf_dir: str, *flags: str) -> DataFrame:
    return R.rank_intervals(scored(spark, sf_dir), T, flags=flags)


def rank_metrics(spark, sf_dir):
    per = R.problem_metrics(ranked(spark, sf_dir, "passed"), T, ks=(4,))
    return rounded(R.macro_average(per, ["rs", "mrr", "top1", "b_of_4"]))


def rank_metrics_by_problem(spark, sf_dir):
    per = R.problem_metrics(ranked(spark, sf_dir, "passed"), T, ks=(4, 16))
    return rounded(per.select("task_id", "n", "r", "unique_preds", "rs", "mrr", "top1", "b_of_4", "b_of_16"))


def rank_metrics_unweighted(spark, sf_dir):
    d = R.rank_intervals(scored(spark, sf_dir), T, count=None, flags=["passed"])
    return rounded(R.macro_average(R.problem_metrics(d, T, ks=(2,), strict=False), ["rs", "mrr", "top1", "b_of_2"]))


def rank_categories(spark, sf_dir):
    """Outcome categories: all ks for ``all``, only the largest for the others."""
    of = {"all": ("passed", (4, 16)), "public": ("passed_public", (16,)), "plus": ("passed_plus", (16,))}
    per = R.category_metrics(ranked(spark, sf_dir, *[f for f, _ in of.values()]), T, of)
    names = [f"{c}{m}" for c, (_, ks) in of.items() for m in ("rs", "mrr", "top1", *[f"b_of_{k}" for k in ks])]
    return rounded(R.long_form(per.agg(*[F.avg(n).alias(n) for n in names]), [], of))


def rank_vector(spark, sf_dir):
    d = R.display_score(ranked(spark, sf_dir), T)
    return rounded(d.select("task_id", "sid", "lo", "hi", "shown"))


def ndcg_all(spark, sf_dir):
    return rounded(R.ndcg(ranked(spark, sf_dir), T))


def ndcg_at_k(spark, sf_dir):
    return rounded(R.ndcg(ranked(spark, sf_dir), T, k=10).agg(F.avg("ndcg").alias("ndcg_at_10"), F.count(F.lit(1)).alias("problems")))


def pass_at_k(spark, sf_dir):
    w = F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).cast("bigint")
    d = scored(spark, sf_dir).groupBy("task_id").agg(F.sum(w).alias("n"), F.sum(F.when(F.col("passed"), w).otherwise(0)).alias("c"))
    return rounded(d.select("task_id", "n", "c", *[R.pass_at_k(F.col("n"), F.col("c"), k).alias(f"pass_at_{k}") for k in (1, 10, 100)]))


def collisions(spark, sf_dir):
    d = R.collisions(ranked(spark, sf_dir), T)
    out = d.agg(F.sum("num_collisions").alias("num_collisions"), F.sum("unique_preds").alias("unique_preds"))
    return out.withColumn("pct_collisions", F.round(F.try_divide(F.col("num_collisions"), F.col("unique_preds")), 6))


def timing_stats(spark, sf_dir):
    return rounded(R.timing_stats(scored(spark, sf_dir), T), nudge=1e-9)


def oracle_logprob_majority(spark, sf_dir):
    d = table(spark, sf_dir, "solutions").filter("task_id is not null and solution is not null")
    d = d.withColumn("pos", F.col("solution_key"))
    sel = R.selection_ranks(d, T, "pos", "logprob", "passed", "count")
    maj = R.majority_vote(d, T, "solution", "logprob", "solution_key", "passed", "count")
    return sel.join(maj, T).select("task_id", "oracle", "num_passed", "logprob_passed", "lp_first_pass_pos", "majority_passed", "majority_votes")


def ranking_summary(spark, sf_dir):
    d = oracle_logprob_majority(spark, sf_dir)
    return rounded(d.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.avg(F.col("oracle").cast("double")).alias("oracle_rate"),
        F.avg(F.col("majority_passed").cast("double")).alias("majority_rate"),
        F.avg(F.col("logprob_passed").cast("double")).alias("logprob_rate"),
        F.avg("num_passed").alias("mean_passed"),
    ))


QUERIES = {f.__name__: f for f in (rank_metrics, rank_metrics_by_problem, rank_metrics_unweighted, rank_categories, rank_vector, ndcg_all, ndcg_at_k, pass_at_k, collisions, timing_stats, oracle_logprob_majority, ranking_summary)}


def _bof(k: int, faithful: bool = True, p: str = "passed") -> str:
    """The textbook sum over ranks, with binomials by log-gamma."""
    last = f"n - {k}" if faithful else f"n - {k} + 1"
    c = lambda a, b: f"(lgamma({a} + 1.0) - lgamma({b} + 1.0) - lgamma({a} - {b} + 1.0))"
    return f"coalesce(sum(exp({c('(n - i - 1)', k - 1)} - {c('n', k)})) filter (coalesce({p}, false) and i < {last} and n >= {k}), 0)"


def _metrics(p: str, ks: tuple[int, ...]) -> str:
    more = "".join(f", {_bof(k, True, p)} b_of_{k}" for k in ks)
    return f"""select task_id, max(n) n, max(r2) r, case when max(r2) <= 1 then 0 else count(*) filter (coalesce({p}, false) and i < r2) / max(r2)::double end rs,
  coalesce(1.0 / (min(i) filter (coalesce({p}, false)) + 1), 0)::double mrr, (bool_or(coalesce({p}, false) and i = 0))::int::double top1{more}
  from (select *, count(*) over (partition by task_id) n, count(*) filter (coalesce({p}, false)) over (partition by task_id) r2 from x) group by 1"""


def _round(sql: str, cols: dict[str, str]) -> str:
    return "select " + ", ".join(f"round({c}, 6) {c}" if t == "d" else c for c, t in cols.items()) + f" from ({sql})"


_PICK = """p as (select *, coalesce(logprob, '-infinity'::double) lp, coalesce(count, 1) w, coalesce(passed, false) ok from solutions where task_id is not null and solution is not null),
sel as (select task_id, bool_or(ok) oracle, sum(case when ok then w else 0 end)::bigint num_passed, count(*) n from p group by 1),
lpp as (select task_id, ok logprob_passed from p qualify row_number() over (partition by task_id order by lp desc, solution_key) = 1),
fp as (select task_id, solution_key pos from p where ok qualify row_number() over (partition by task_id order by lp desc, solution_key) = 1),
vg as (select task_id, solution, sum(w)::bigint votes, min(solution_key) first from p group by 1, 2),
vl as (select task_id, solution, passed mp from p qualify row_number() over (partition by task_id, solution order by lp, solution_key desc) = 1),
mv as (select * from vg join vl using (task_id, solution) qualify row_number() over (partition by task_id order by votes desc, first) = 1),
picks as (select task_id, oracle, num_passed, logprob_passed, coalesce(pos, n) + 1 lp_first_pass_pos, mp majority_passed, votes majority_votes
  from sel join lpp using (task_id) left join fp using (task_id) join mv using (task_id))"""

_D = "1 / log2(i + 2.0)"
_NDCG = """tie as (select task_id, eff, avg(coalesce(g, 0)) m, sum(case when i < {k} then 1 / log2(i + 2.0) else 0 end) d from x group by 1, 2),
dcg as (select task_id, sum(m * d) dcg from tie group by 1),
idl as (select task_id, coalesce(g, 0) g, row_number() over (partition by task_id order by coalesce(g, 0) desc) - 1 i from x),
idcg as (select task_id, sum(case when i < {k} then g / log2(i + 2.0) else 0 end) idcg from idl group by 1),
nd as (select task_id, case when idcg > 0 then 100 * dcg / idcg else 0 end ndcg from dcg join idcg using (task_id))"""

SQL = {
    "rank_metrics": f"with {RANKED}, m as ({_metrics('passed', (4,))}) select count(*) problems, round(avg(rs), 6) rs, round(avg(mrr), 6) mrr, round(avg(top1), 6) top1, round(avg(b_of_4), 6) b_of_4 from m",
    "rank_metrics_by_problem": f"with {RANKED}, m as ({_metrics('passed', (4, 16))}), u as (select task_id, count(*) unique_preds from iv group by 1) select task_id, n, r, unique_preds, round(rs, 6) rs, round(mrr, 6) mrr, round(top1, 6) top1, round(b_of_4, 6) b_of_4, round(b_of_16, 6) b_of_16 from m join u using (task_id)",
    "rank_metrics_unweighted": f"""with {SCORED}, e as (select *, case when score is null or isnan(score) then '-infinity'::double else score end eff from scored),
x as (select *, row_number() over (partition by task_id order by eff desc, sid) - 1 i, count(*) over (partition by task_id) n, count(*) filter (passed) over (partition by task_id) r from e),
m as (select task_id, case when max(r) = 0 then 0 else count(*) filter (passed and i < r) / max(r)::double end rs, coalesce(1.0 / (min(i) filter (passed) + 1), 0)::double mrr,
  (bool_or(coalesce(passed, false) and i = 0))::int::double top1, {_bof(2, False)} b_of_2 from x group by 1)
select count(*) problems, round(avg(rs), 6) rs, round(avg(mrr), 6) mrr, round(avg(top1), 6) top1, round(avg(b_of_2), 6) b_of_2 from m""",
    "rank_categories": f"with {RANKED}, "
    + ", ".join(f"m_{c} as ({_metrics(p, ks)})" for c, p, ks in (("all", "passed", (4, 16)), ("public", "passed_public", (16,)), ("plus", "passed_plus", (16,))))
    + " ".join([""] + [f"{'' if c == 'all' and m == 'rs' else 'union all '}select '{c}' category, '{m}' metric, round(avg({m}), 6) \"value\" from m_{c}" for c, ms in (("all", ("rs", "mrr", "top1", "b_of_4", "b_of_16")), ("public", ("rs", "mrr", "top1", "b_of_16")), ("plus", ("rs", "mrr", "top1", "b_of_16"))) for m in ms]),
    "rank_vector": f"with {RANKED}, l as (select task_id, min(eff) filter (eff > '-infinity'::double) least from iv group by 1) select task_id, sid, lo, hi, round(case when eff > '-infinity'::double then eff else coalesce(least - 1, -11) end, 6) shown from iv join l using (task_id)",
    "ndcg_all": f"with {RANKED}, {_NDCG.format(k='1e18')} select task_id, round(ndcg, 6) ndcg from nd",
    "ndcg_at_k": f"with {RANKED}, {_NDCG.format(k=10)} select round(avg(ndcg), 6) ndcg_at_10, count(*) problems from nd",
    "pass_at_k": f"with {RANKED} select task_id, n, r c, "
    + ", ".join(f"round(case when n - r < {k} then 1 else 1 - coalesce((select exp(sum(ln(1 - {k} / j::double))) from (select unnest(range(n - r + 1, n + 1)) j)), 1) end, 6) pass_at_{k}" for k in (1, 10, 100))
    + " from tot",
    "collisions": f"with {RANKED}, c as (select task_id, eff, sum(w) c, count(*) u from iv group by 1, 2) select count(*) filter (c > 1) num_collisions, sum(u)::bigint unique_preds, round(count(*) filter (c > 1) / sum(u), 6) pct_collisions from c",
    "timing_stats": f"with {SCORED}, t as (select task_id, case when not coalesce(filtered_out, false) then score_time end s from scored) select task_id, round(avg(s) + 1e-9, 6) time_mean, round(median(s) + 1e-9, 6) time_median, round(stddev_pop(s) + 1e-9, 6) time_std, round(sum(s) + 1e-9, 6) time_sum from t group by 1",
    "oracle_logprob_majority": f"with {_PICK} select * from picks",
    "ranking_summary": f"with {_PICK} select count(*) tasks, round(avg(oracle::int), 6) oracle_rate, round(avg(majority_passed::int), 6) majority_rate, round(avg(logprob_passed::int), 6) logprob_rate, round(avg(num_passed), 6) mean_passed from picks",
}
