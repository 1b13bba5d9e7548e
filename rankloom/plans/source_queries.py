"""Queries that write with the engine's sinks and read back with its sources, and those over records, tests and joins."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import filters as FI
from rankloom.operators import joins as J
from rankloom.operators import projections as P
from rankloom.operators import ranking as R
from rankloom.operators import reshape as U
from rankloom.operators import scoring as SC
from rankloom.operators import tokenize as K
from rankloom.operators import trials as TR
from rankloom.operators.aggregates import validation_metrics as pooled
from rankloom.plans import relational_queries as Q
from rankloom.plans.config import DataConfig
from rankloom.plans.fixtures import RANKED, SCORED, TRIALS, scored, trials
from rankloom.plans.ranking_queries import _metrics, ranked, rounded
from rankloom.plans.relational_queries import solutions
from rankloom.session import drop_path, shared_dir, table
from rankloom.sources import readers, writers


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of the shared file system for one query's files, deleted with the session."""
    path = f"{shared_dir(spark)}/rankloom-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


CANDIDATE = ["sid", "completion_id", "solution", "passed", "passed_public", "passed_plus", "timed_out", "logprob", "count", "elapsed", "num_tests_passed", "outcomes", "plus_outcomes"]
CELL = ["model", "setup", "dataset"]


def _candidates(spark, sf_dir) -> DataFrame:
    d = solutions(spark, sf_dir).filter("model is not null and setup is not null and dataset is not null")
    return d.drop("sid").withColumn("sid", F.col("solution_key").cast("int"))


def _nested(spark, sf_dir) -> DataFrame:
    """Candidate records, one row for each problem of each cell."""
    d = U.renest(_candidates(spark, sf_dir), ["task_id", *CELL], CANDIDATE, "solutions", "sid")
    r = P.problem_record(F.col("solutions"))
    return d.withColumns({k: v for k, v in r.items() if k != "solutions"})


def _flat(problems: DataFrame) -> DataFrame:
    d = U.unnest(problems, "solutions", ["task_id", *CELL])
    return d.select("task_id", *CELL, "sid", "completion_id", F.md5("solution").alias("h"), "passed", "count", "logprob", F.size("outcomes").alias("tests"))


def candidate_files(spark, sf_dir):
    """Candidates to gzipped JSON lines and back."""
    path = scratch(spark, "candidates")
    writers.jsonl(_nested(spark, sf_dir), path)
    return _flat(readers.jsonl(spark, path, "problem", partitions=8))


def candidate_cells(spark, sf_dir):
    """Candidates to one folder for each cell and back through the partitions."""
    path = scratch(spark, "cells")
    writers.partitioned(_nested(spark, sf_dir), path)
    return _flat(spark.read.parquet(path))


def candidate_tree(spark, sf_dir):
    """Candidates in folders of model and setup, with both read from the paths."""
    path = scratch(spark, "tree")
    _nested(spark, sf_dir).withColumns({"m": F.col("model"), "s": F.col("setup")}).write.option("compression", "gzip").partitionBy("m", "s").json(path)
    d = readers.tree(spark, path, "problem", "*.json.gz")
    return d.groupBy("tree_model", "tree_setup").agg(F.count(F.lit(1)).alias("problems"), F.sum(F.size("solutions")).alias("candidates"), F.bool_and((F.col("model") == F.col("tree_model")) & (F.col("setup") == F.col("tree_setup"))).alias("agree"))


def hosted_subset(spark, sf_dir):
    """The first cell as a hosted subset, by its name."""
    path = scratch(spark, "hub")
    d = _nested(spark, sf_dir)
    first = d.agg(F.min(F.struct(*CELL)).alias("c")).first().c
    cell = d.filter((F.col("model") == first.model) & (F.col("setup") == first.setup) & (F.col("dataset") == first.dataset))
    cell.write.parquet(f"{path}/{readers.subset_name(first.model, first.setup, first.dataset)}")
    return _flat(readers.subset(spark, path, first.model, first.setup, first.dataset))


def prediction_files(spark, sf_dir):
    """Raw predictions: one prompt's samples serialised in order, as lines, and read with the task of their file."""
    path = scratch(spark, "predictions")
    d = solutions(spark, sf_dir).select("task_id", F.col("solution_key").alias("completion_id"), F.col("solution").alias("prediction"), F.col("logprob").alias("cumulative_logprob"), "num_tokens")
    writers.jsonl(J.serialized(d, ["task_id"], ["completion_id", "prediction", "cumulative_logprob", "num_tokens"], "completion_id"), f"{path}/raw")
    d = readers.predictions(spark, f"{path}/raw")
    return d.select("task_id", F.inline("predictions")).select("task_id", "completion_id", F.md5("prediction").alias("h"), "num_tokens")


def shard_files(spark, sf_dir):
    """Shards of at most 1000 rows, read back and joined with their metadata by index; both must agree on the task."""
    path = scratch(spark, "shards")
    d = solutions(spark, sf_dir).filter("solution_key <= 2147483647").select(F.col("solution_key").cast("int").alias("idx"), "task_id", F.array("solution").alias("predictions"), F.array("logprob").alias("cum_log_probs"), F.array("num_tokens").alias("num_tokens"))
    writers.sharded(d, path, 1000)
    meta = table(spark, sf_dir, "solutions").select(F.col("solution_key").cast("int").alias("idx"), "task_id", "setup")
    got = readers.shards(spark, path)
    got = got.withColumn("file", F.col("_metadata.file_name"))
    got = J.validated_join(got.select("idx", "task_id", F.size("predictions").alias("samples"), "file"), meta, "idx", ["task_id"])
    most = got.groupBy("file").agg(F.count(F.lit(1)).alias("rows")).agg((F.max("rows") <= 1000).alias("small"))
    return got.drop("file").crossJoin(F.broadcast(most))  # one row


def trial_files(spark, sf_dir):
    """One file a trial beside a result table that isn't read, aggregated over trials."""
    folder = scratch(spark, "trials")
    d = trials(spark, sf_dir)
    for n in [r.trial for r in d.select("trial").filter("trial is not null").distinct().orderBy("trial").collect()]:
        writers.trial(d.filter(F.col("trial") == n), folder, n)
    TR.collapse_trials(d, Q.KEY).write.parquet(f"{folder}/results.parquet")
    return TR.trial_totals(readers.trial_results(spark, folder)).select("trial", "programs_passed", "num_preds")


def flag_files(spark, sf_dir):
    """Wide flags to gzipped CSV and back."""
    path = scratch(spark, "flags")
    d = Q.filter_pivot(spark, sf_dir).withColumns({"generator": F.lit("g"), "sampling_setup": F.lit("s"), "dataset": F.lit("d")})
    cols = readers.schema("filter_flags").fieldNames()
    writers.csv(d.withColumn("sid", F.col("sid").cast("int")).select(*cols), path)
    return readers.flags(spark, path).drop("generator", "sampling_setup", "dataset")


def timing_files(spark, sf_dir):
    """Filter timings to plain CSV and back; an empty field is null again."""
    path = scratch(spark, "timings")
    cols = ["generator", "sampling_setup", "dataset", "filter_name", "time"]
    writers.csv(table(spark, sf_dir, "filter_timings_summary").select(*cols), path, compressed=False)
    d = readers.filter_timings(spark, path).filter("not isnan(time)")
    return rounded(d.groupBy("filter_name", "dataset").agg(F.count("time").alias("runs"), F.sum("time").alias("total")), 4)


def metrics_document(spark, sf_dir):
    """A report as one sorted JSON document, written and read."""
    path = scratch(spark, "metrics")
    per = R.problem_metrics(ranked(spark, sf_dir, "passed"), ["task_id"], ks=(4,)).withColumn("task", F.substring_index("task_id", "/", 1))
    wide = R.macro_average(per, ["rs", "mrr", "top1", "b_of_4"], ["task"]).drop("problems")
    writers.metrics_json(spark, wide.unpivot(["task"], ["rs", "mrr", "top1", "b_of_4"], "metric", "value"), f"{path}/overall.json")
    doc = readers.document(spark, f"{path}/overall.json")
    assert list(doc) == sorted(doc)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in doc.items()], "key string, value double"))


def problem_score_files(spark, sf_dir):
    """Scored candidates nested by problem, by falling score, with the statistics of their times."""
    path = scratch(spark, "scores")
    writers.problem_scores(scored(spark, sf_dir).filter("score is not null and not isnan(score)").select("task_id", "sid", "score", "score_time", "passed"), path)
    d = spark.read.schema("task_id string, solutions array<struct<sid int, score string, passed boolean>>, time_sum double, time_mean double, time_median double, time_std double").json(path)
    return rounded(d.select("task_id", F.size("solutions").alias("candidates"), F.col("solutions")[0]["sid"].alias("best"), F.col("time_sum") + 1e-9, F.col("time_median") + 1e-9).toDF("task_id", "candidates", "best", "time_sum", "time_median"), 4)


def split_files(spark, sf_dir):
    """Parts saved as the splits of one dataset, each read on its own, and concatenated."""
    path = scratch(spark, "splits")
    d = table(spark, sf_dir, "problems").select("problem_key", "task_id", "split")
    writers.splits({n: d.filter(F.col("split") == n).drop("split") for n in ("train", "validation", "test")}, path)
    parts = [readers.split(spark, path, n) for n in ("train", "validation", "test")]
    return U.concatenated(parts)


def execution_files(spark, sf_dir):
    """Execution problems with their tests, to JSON lines and back."""
    path = scratch(spark, "execution")
    tests = F.struct(F.transform("outcomes", lambda x: x.cast("string")).alias("input"), F.transform("outcomes", lambda x: (~x).cast("string")).alias("output"))
    d = solutions(spark, sf_dir).select("task_id", "model", F.col("setup").alias("sampling_setup"), F.array(F.struct("solution", F.col("solution_key").cast("string").alias("sid"))).alias("solutions"), tests.alias("public_tests"), F.transform("outcomes", lambda x, i: i % 3).alias("test_types"))
    writers.jsonl(d, path)
    got = readers.execution_problems(spark, path).filter(FI.has_public_tests(F.col("public_tests")))
    return got.select(F.col("solutions")[0]["sid"].cast("bigint").alias("solution_key"), F.size("public_tests.input").alias("tests"), *[c.alias(n) for n, c in P.tests_by_type(F.col("test_types")).items()])


def benchmark_rows(spark, sf_dir):
    """The four benchmarks in common form: id and the text that is asked, with the tests' fields where there are some."""
    d = table(spark, sf_dir, "problems").filter("description is not null")
    raw = {
        "code_contests": d.select(F.col("problem_key").alias("idx"), "description"),
        "gsm8k": d.select(F.col("problem_key").alias("idx"), F.col("description").alias("question"), F.col("task_id").alias("answer")),
        "mbpp": d.select("task_id", F.col("description").alias("prompt"), F.lit("f").alias("entry_point"), F.array(F.lit("assert f(1) == 1"), F.lit("assert f(2) == 2")).alias("test_list")),
        "humaneval": d.select("task_id", F.col("description").alias("prompt"), F.lit("g").alias("entry_point"), F.lit("check(g)").alias("test")),
    }
    parts = [readers.load_benchmark(x, n).select(F.lit(n).alias("benchmark"), "task_id", F.md5("query").alias("h"), F.size("tests").alias("tests")) for n, x in raw.items()]
    return U.concatenated(parts)


def problem_records(spark, sf_dir):
    d = _nested(spark, sf_dir)
    return d.select("task_id", *CELL, "num_passed", "num_passed_public", "num_passed_plus", F.size(P.problem_record(F.col("solutions"))["solutions"]).alias("candidates"))


def composite_ids(spark, sf_dir):
    return solutions(spark, sf_dir).select("solution_key", X.composite_id(F.col("task_id"), F.coalesce("source", F.lit("-")), F.col("solution_key")).alias("id"))


def hidden_outcomes(spark, sf_dir):
    d = trials(spark, sf_dir).filter("passed_private is not null or passed_generated is not null")
    return d.groupBy("trial").agg(F.count_if(P.hidden_outcome(F.col("passed_private"), F.col("passed_generated"))).alias("hidden"), F.count(F.lit(1)).alias("n"))


def default_passes(spark, sf_dir):
    return P.default_passes(solutions(spark, sf_dir).select("solution_key", "passed", "passed_public", "passed_plus"), ["passed", "passed_public", "passed_plus", "passed_private"])


def scored_records(spark, sf_dir):
    """Scored candidates and pruned ones as one table of records."""
    kept, pruned = FI.split_kept(Q._filtered(spark, sf_dir))
    d = U.concatenated([P.scored_record(kept, False), P.scored_record(pruned, True)])
    d = d.groupBy("filtered_out").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == float("-inf")).alias("lowest"), F.sum("score_time").alias("time"), F.sum("count").alias("weight"))
    return rounded(d, 4)


def flat_structs(spark, sf_dir):
    counts = F.struct("num_passed", F.struct("num_passed_public", "num_passed_plus").alias("by"))
    return U.flatten_structs(table(spark, sf_dir, "problems").select("problem_key", counts.alias("counts")))


def long_programs_dropped(spark, sf_dir):
    """Programs of up to 400 characters of each problem, with the counts made again."""
    d = solutions(spark, sf_dir).select("task_id", "solution_key", F.col("solution").alias("code"), "passed", "passed_public", "passed_plus")
    d = U.renest(d, ["task_id"], ["code", "passed", "passed_public", "passed_plus"], "predictions", "solution_key")
    r = P.problem_record(FI.drop_long_programs(F.col("predictions"), 400))
    return d.select("task_id", F.size(r["solutions"]).alias("programs"), r["num_passed"].alias("num_passed"), r["num_passed_plus"].alias("num_passed_plus"))


def pair_lengths(spark, sf_dir):
    """Pairs of a passing and a failing program, without those that have a side of more than 400 tokens (here bytes)."""
    pairs = Q.pairwise_sample(spark, sf_dir)
    ids = K.token_ids(solutions(spark, sf_dir).filter("solution is not null").select("solution_key", "solution"), "solution", "ids").drop("solution")
    side = lambda c: ids.select(F.col("solution_key").alias(c), F.col("ids").alias(f"{c}_ids"))
    d = pairs.join(side("chosen"), "chosen").join(side("rejected"), "rejected")
    return K.pair_rows(d, "chosen_ids", "rejected_ids", 400).select("task_id", "rn", "chosen", "rejected", F.size("chosen_ids").alias("chosen_n"), F.size("rejected_ids").alias("rejected_n"))


def class_rows(spark, sf_dir):
    """Whole texts with their outcome as the label, the last 64 tokens (here bytes) with an end token."""
    d = K.token_ids(solutions(spark, sf_dir).filter("solution is not null").select("solution_key", "solution", "passed"), "solution", "ids")
    d = K.classification_rows(d, "ids", "passed", 257, 64)
    return d.select("solution_key", F.size("input_ids").alias("n"), F.element_at("input_ids", -1).alias("last_id"), "labels")


def largest_ks(spark, sf_dir):
    per = R.problem_metrics(ranked(spark, sf_dir, "passed"), ["task_id"], ks=())
    return spark.createDataFrame([(k,) for k in R.largest_ks(per, (4, 16, 64, 1_000_000))], "k int")


def metadata_join(spark, sf_dir):
    """Problems with the tests and limits of their benchmark's record, which must agree on split and task."""
    p = table(spark, sf_dir, "problems")
    meta = p.select("problem_key", "split", "task_id", F.coalesce("num_pub_tests", F.lit(0)).alias("tests"))
    return J.validated_join(p.select("problem_key", "split", "task_id", F.length("description").alias("chars")), meta, "problem_key", ["split", "task_id"])


def checked_results(spark, sf_dir):
    """Execution results with the prediction that each belongs to."""
    p = scored(spark, sf_dir).select("task_id", "sid", "score")
    r = scored(spark, sf_dir).filter("passed").select("task_id", "sid", "num_tests_passed")
    return rounded(J.checked_join(r, p, ["task_id", "sid"]))


def prompt_repeats(spark, sf_dir):
    """Each prompt three times, and the samples of its repeats merged again in order."""
    d = table(spark, sf_dir, "problems").select("problem_key")
    r = J.repeated_prompts(d, 3).withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.col("problem_key") * 10 + F.col("rep") * 2 + i))
    m = J.merged_repeats(r.select("problem_key", "rep", "samples"), ["problem_key"], "samples", F.lit(6))
    return m.select("problem_key", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


def missing_datasets(spark, sf_dir):
    d = _candidates(spark, sf_dir).groupBy("model", "setup").agg(F.collect_set("dataset").alias("have"))
    want = F.array(*map(F.lit, ("code_contests", "gsm8k", "humaneval", "mbpp", "other")))
    return d.select("model", "setup", F.array_join(F.array_sort(U.missing_members(F.col("have"), want)), ",").alias("missing"))


def model_scores(spark, sf_dir):
    """The scorers by name, over the same logits."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    a, b = F.slice("e", 1, 4), F.slice("e", 5, 4)
    runs = {
        "binary_logit": lambda f: f(d, a, b),
        "binary_logprob": lambda f: f(d, a, b),
        "st_binary_logit": lambda f: f(d, F.col("e"), 3, 5),
        "st_binary_logprob": lambda f: f(d, F.col("e"), 3, 5),
        "classification": lambda f: f(d, F.slice("e", 1, 2)),
        "reward_model": lambda f: f(d, F.element_at("e", 1)),
        "logprob": lambda f: f(d, F.col("e"), F.transform("e", lambda x, i: (i % 2).cast("int"))).withColumn("failed_score", F.lit(None).cast("double")),
    }
    return rounded(U.concatenated([run(SC.scorer(n)).select(F.lit(n).alias("scorer"), "vec_id", "score", "failed_score") for n, run in runs.items()]))


def validation_metrics(spark, sf_dir):
    """Ranking metrics by task, then the mean over tasks."""
    per = R.problem_metrics(ranked(spark, sf_dir, "passed"), ["task_id"], ks=()).withColumn("task", F.substring_index("task_id", "/", 1))
    return rounded(pooled(R.macro_average(per, ["rs", "mrr"], ["task"]), ["rs", "mrr"]))


def dataset_names(spark, sf_dir):
    """The folder names of the training sets of the settings' grid."""
    grid = [(n, f, s) for n in (-1, 4) for f in (True, False) for s in (True, False)]
    return spark.createDataFrame([(n, f, s, DataConfig(examples_per_problem=n, include_failed=f, include_syntax=s).dir_name()) for n, f, s in grid], "per int, failed boolean, syntax boolean, name string")


QUERIES = {
    f.__name__: f
    for f in (
        candidate_files, candidate_cells, candidate_tree, hosted_subset, prediction_files, shard_files, trial_files, flag_files, timing_files, metrics_document, problem_score_files, split_files,
        execution_files, benchmark_rows, problem_records, composite_ids, hidden_outcomes, default_passes, scored_records, flat_structs, long_programs_dropped, pair_lengths, class_rows, largest_ks,
        metadata_join, checked_results, prompt_repeats, missing_datasets, model_scores, validation_metrics, dataset_names,
    )
}

_S = "s as (select * from solutions where task_id is not null)"
_C = "c as (select * exclude (sid), solution_key::int sid from solutions where task_id is not null and model is not null and setup is not null and dataset is not null)"
_FLAT = "select task_id, model, setup, dataset, sid, completion_id, md5(solution) h, passed, count, logprob, len(outcomes)::int tests from c"
_E = "e as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings)"

SQL = {
    "candidate_files": f"with {_C} {_FLAT}",
    "candidate_cells": f"with {_C} {_FLAT}",
    "candidate_tree": f"with {_C} select model tree_model, setup tree_setup, count(distinct (task_id, dataset)) problems, count(*) candidates, true agree from c group by 1, 2",
    "hosted_subset": f"with {_C} {_FLAT} where (model, setup, dataset) = (select min((model, setup, dataset)) from c)",
    "prediction_files": f"with {_S} select task_id, solution_key::int completion_id, md5(solution) h, num_tokens from s",
    "shard_files": f"with {_S} select solution_key::int idx, task_id, 1 samples, setup, true small from s",
    "trial_files": f"with {TRIALS} select trial, count(*) filter (passed) programs_passed, count(*) num_preds from trials group by 1",
    "flag_files": f"with {Q._PIVOT} select * replace (sid::int as sid) from flags",
    "timing_files": "select filter_name, dataset, count(time) runs, round(sum(time), 4) total from filter_timings_summary where time is not null and not isnan(time) group by 1, 2",
    "metrics_document": f"with {RANKED}, m as ({_metrics('passed', (4,))}), a as (select split_part(task_id, '/', 1) task, avg(rs) rs, avg(mrr) mrr, avg(top1) top1, avg(b_of_4) b_of_4 from m group by 1) select task || '/' || metric \"key\", round(v, 6) \"value\" from (unpivot a on rs, mrr, top1, b_of_4 into name metric value v)",
    "problem_score_files": f"with {SCORED} select task_id, count(*)::int candidates, first(sid order by score desc nulls last, sid) best, round(sum(score_time) + 1e-9, 4) time_sum, round(median(score_time) + 1e-9, 4) time_median from scored where score is not null and not isnan(score) group by 1",
    "split_files": "select problem_key, task_id, split from problems where split in ('train', 'validation', 'test')",
    "execution_files": f"with {_S} select solution_key, len(outcomes)::int tests, {', '.join(f'((len(outcomes) + {2 - k}) // 3)::int {n}' for k, n in enumerate(('public', 'private', 'generated')))} from s where len(outcomes) > 0",
    "benchmark_rows": """with d as (select * from problems where description is not null)
select 'code_contests' benchmark, 'code_contests/' || problem_key task_id, md5(description) h, 0 tests from d union all select 'gsm8k', 'gsm8k/' || problem_key, md5(description), 0 from d
union all select 'mbpp', task_id, md5(description || chr(10) || 'assert f(1) == 1' || chr(10) || 'assert f(2) == 2'), 2 from d union all select 'humaneval', task_id, md5(description), 1 from d""",
    "problem_records": f"with {_C} select task_id, model, setup, dataset, (count(*) filter (passed))::int num_passed, (count(*) filter (passed_public))::int num_passed_public, (count(*) filter (passed_plus))::int num_passed_plus, count(*)::int candidates from c group by 1, 2, 3, 4",
    "composite_ids": f"with {_S} select solution_key, task_id || '/' || coalesce(source, '-') || '/' || solution_key id from s",
    "hidden_outcomes": f"with {TRIALS} select trial, count(*) filter (coalesce(passed_private, passed_generated) and coalesce(passed_generated, passed_private)) hidden, count(*) n from trials where passed_private is not null or passed_generated is not null group by 1",
    "default_passes": f"with {_S} select solution_key, coalesce(passed, false) passed, coalesce(passed_public, false) passed_public, coalesce(passed_plus, false) passed_plus, false passed_private from s",
    "scored_records": f"with {Q._KEEP} select not keep filtered_out, count(*) n, count(*) filter (not keep or score = '-infinity'::double) lowest, round(sum(case when keep then score_time else 0 end), 4) \"time\", sum(count)::bigint weight from kept group by 1",
    "flat_structs": 'select problem_key, num_passed "counts.num_passed", num_passed_public "counts.by.num_passed_public", num_passed_plus "counts.by.num_passed_plus" from problems',
    "long_programs_dropped": f"with {_S} select task_id, (count(*) filter (length(solution) <= 400))::int programs, (count(*) filter (length(solution) <= 400 and passed))::int num_passed, (count(*) filter (length(solution) <= 400 and passed_plus))::int num_passed_plus from s group by 1",
    "pair_lengths": f"with p as ({Q.SQL['pairwise_sample']}), n as (select solution_key k, octet_length(encode(solution))::int n from solutions where solution is not null) select p.*, a.n chosen_n, b.n rejected_n from p join n a on a.k = chosen join n b on b.k = rejected where a.n <= 400 and b.n <= 400",
    "class_rows": f"with {_S} select solution_key, least(octet_length(encode(solution)) + 1, 64)::int n, 257 last_id, coalesce(passed, false)::int labels from s where solution is not null",
    "largest_ks": f"with {SCORED}, u as (select count(*) n from scored group by task_id), m as (select max(n) m from u), k as (select unnest([4, 16, 64, 1000000]) k), r as (select k from k where k <= (select m from m)) select k::int k from r union all select m::int from m where not exists (select 1 from r)",
    "metadata_join": "select problem_key, split, task_id, length(description)::int chars, coalesce(num_pub_tests, 0) tests from problems",
    "checked_results": f"with {SCORED} select task_id, sid, num_tests_passed, round(score, 6) score from scored where passed",
    "prompt_repeats": "select problem_key, array_to_string(list_transform(range(6), lambda i: problem_key * 10 + i), ',') samples from problems",
    "missing_datasets": f"with {_C} select model, setup, array_to_string(list_sort(list_filter(['code_contests', 'gsm8k', 'humaneval', 'mbpp', 'other'], lambda x: not list_contains(h, x))), ',') missing from (select model, setup, list(distinct dataset) h from c group by 1, 2)",
    "model_scores": f"""with {_E} select 'binary_logit' scorer, vec_id, round(list_avg(e[1:4]), 6) score, round(list_avg(e[5:8]), 6) failed_score from e
union all select 'binary_logprob', vec_id, round(list_sum(e[1:4]) / 5, 6), round(list_sum(e[5:8]) / 5, 6) from e
union all select unnest(['st_binary_logit', 'st_binary_logprob']), vec_id, round(e[4], 6), round(e[6], 6) from e
union all select 'classification', vec_id, round(e[2], 6), round(e[1], 6) from e union all select 'reward_model', vec_id, round(e[1], 6), round(-e[1], 6) from e
union all select 'logprob', vec_id, round(list_avg(list_filter(e, lambda x, i: i % 2 = 0)), 6), null from e""",
    "validation_metrics": f"with {RANKED}, m as ({_metrics('passed', ())}), t as (select split_part(task_id, '/', 1) t, avg(rs) rs, avg(mrr) mrr from m group by 1) select round(avg(rs), 6) rs, round(avg(mrr), 6) mrr from t",
    "dataset_names": "select n::int per, f failed, s syntax, 'train_passed' || case when f then '_failed' else '' end || case when s then '_syntax' else '' end || case when n >= 0 then '_per=' || n else '' end \"name\" from (select unnest([-1, 4]) n), (select unnest([true, false]) f), (select unnest([true, false]) s)",
}
