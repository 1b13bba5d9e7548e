"""Dedup, trials, reshaping, sampling, packing, joins, sources and streams on small tables."""

import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions import arrays as A
from rankloom.functions import code as C
from rankloom.functions import templates as T
from rankloom.functions import text as X
from rankloom.operators import batching as B
from rankloom.operators import dedup as D
from rankloom.operators import execution as E
from rankloom.operators import joins as J
from rankloom.operators import projections as P
from rankloom.operators import reshape as U
from rankloom.operators import sampling as S
from rankloom.operators import scoring as SC
from rankloom.operators import skew
from rankloom.operators import tokenize as K
from rankloom.operators import trials as TR
from rankloom.plans.config import SUITES, EvalSuite, PreprocessorConfig, RunConfig, ScoringConfig, TaskConfig
from rankloom.plans import training as TN
from rankloom.plans.suite import Model, evaluate, prepared, run_suite, suite_report
from rankloom.session import Steps, materialize
from rankloom.sources import readers, writers
from rankloom.streaming import trials as ST


def test_three_ways_to_merge(spark):
    rows = [("a", 0, "x", -2.0, 5, True, "p"), ("a", 1, "x", -1.0, 3, False, "q"), ("a", 2, "y", 0.0, 1, True, "r"), ("a", 3, None, -1.0, 0, True, "s"), ("b", 4, "x", None, 9, True, "t")]
    df = spark.createDataFrame(rows, "t string, pos int, s string, logprob double, completion_id int, ok boolean, src string")
    m = {(r.t, r.text): r for r in D.dedup_max_logprob(df, ["t"], F.col("s"), "pos", first=["src"]).collect()}
    assert (m["a", "x"]["count"], m["a", "x"].logprob, m["a", "x"].completion_id, m["a", "x"].src, m["a", "x"].pos) == (2, -1.0, 3, "p", 0)
    assert m["a", "y"].logprob is None and m["b", "x"].logprob is None and len(m) == 3
    n = {(r.t, r.pos): r for r in D.dedup_min_numeric(df, ["t"], F.col("s"), "pos").collect()}
    assert (n["a", 0].completion_id, n["a", 0].ok, n["a", 0].src, n["a", 0].dup_count) == (3, False, "q", 2)
    good, bad = D.dedup_split_syntax(df, ["t"], F.col("s"), F.col("text") == "x", ["completion_id"], passed="ok")
    assert good.count() == 2 and [r.ok for r in bad.collect()] == [False]
    assert D.total_preserved(df.filter("s is not null"), good.unionByName(bad)).first().preserved


def test_trials(spark):
    rows = [(0, "a", "0", True, {"execution_time": 1.0}), (1, "a", "0", False, {"execution_time": 3.0, "other_time": 9.0}), (2, "a", "0", True, None), (0, "b", "0", True, {"execution_time": float("nan")})]
    df = spark.createDataFrame(rows, "trial int, task_id string, sid string, passed boolean, timing map<string,double>")
    flat = TR.flatten_timing(df)
    assert "execution_time" in flat.columns and "timing" not in flat.columns
    agg = {r.task_id: r for r in TR.aggregate_trials(flat, ["task_id"], "trial", ["passed"], ["execution_time"]).collect()}
    assert agg["a"].passed is True and agg["a"].execution_time == 2.0 and agg["a"].execution_time_std == pytest.approx(2**0.5)
    assert agg["b"].execution_time is None
    vals = {r.task_id: r.v for r in TR.agreement(df, ["task_id"], "passed", "trial", "v").collect()}
    assert vals == {"a": "True:2|False:1", "b": None}
    assert TR.repeated(df.limit(1), 3).count() == 3


def test_nested_and_flat(spark):
    df = spark.createDataFrame([("a", 2, True), ("a", 1, None), ("b", 5, False)], "t string, k int, ok boolean")
    nested = U.renest(df, ["t"], ["k", "ok"], "xs", "k")
    assert sorted(map(tuple, U.unnest(nested, "xs", ["t"]).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    pos = {(r.t, r.k): r.sid for r in U.unnest(nested.withColumn("xs", U.with_positions(F.col("xs"))), "xs", ["t"]).collect()}
    assert pos == {("a", 1): 0, ("a", 2): 1, ("b", 5): 0}
    with pytest.raises(Exception, match="unequal"):
        U.zipped(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>"), {"a": "x", "b": "y"}, []).collect()
    s = spark.createDataFrame([((1, (2, "z")),)], "s struct<a:int,b:struct<c:int,d:string>>")
    assert U.flatten_structs(s).columns == ["s.a", "s.b.c", "s.b.d"]


def test_sampling_nests_and_counts(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("t"), F.col("id").alias("s"), (F.col("id") % 3 == 0).alias("ok"))
    small, large = (set(map(tuple, S.pointwise_sample(df, "t", "s", n, 1).select("t", "s").collect())) for n in (2, 4))
    assert small < large and len(small) == 14
    pairs = S.pairwise_sample(df, "t", "s", "ok", 3, 1).collect()
    assert len(pairs) == 21 and all(r.chosen % 3 == 0 and r.rejected % 3 for r in pairs)
    val, train = S.validation_split(df.select("s"), "s", 0.1, 5, 3)
    assert val.count() == 5 and train.count() == 95
    numbered = S.with_row_numbers(df.repartition(5), ["s"], "i")
    assert numbered.filter("i <> s").count() == 0
    assert S.sample_with_replacement(df, "s", 300, 1).count() == 300
    assert S.sample_with_replacement(df.limit(0), "s", 3, 1).count() == 0


def test_packing_keeps_the_budget(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 3000, 500)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)] + [(1000, 9000)], "k bigint, n bigint")
    got = B.packed(df, "n", "k", 4096, 8, partitions=1).toPandas().sort_values(["n", "k"], ascending=[False, True])
    want = B.pack_lengths(got.n.to_numpy(), 4096, 8)
    assert (got.batch.to_numpy() == want).all()
    for _, b in got.groupby("batch"):
        assert len(b) == 1 or len(b) * B.padded_length(b.n.max(), 8) <= 4096
    assert B.packed(df.limit(0), "n", "k", 10).count() == 0


def test_hot_key_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count("*").alias("w"))
    old, skew.MAX_HOT = skew.MAX_HOT, 3
    try:
        assert skew.hot_split_join(left, right, "k", "w").count() == 1000
    finally:
        skew.MAX_HOT = old


def test_joins_check_themselves(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, n string")
    good = spark.createDataFrame([(1, "x", 7), (2, "y", 8)], "i int, n string, m int")
    assert J.validated_join(a, good, "i", ["n"]).columns == ["i", "n", "m"]
    with pytest.raises(Exception, match="disagrees"):
        J.validated_join(a, good.withColumn("n", F.lit("z")), "i", ["n"]).collect()
    with pytest.raises(Exception, match="without prediction"):
        J.checked_join(a, good.limit(1).select("i", "m"), ["i"]).collect()
    r = J.repeated_prompts(a, 2).withColumn("ids", F.array("rep"))
    assert {x.i: x.ids for x in J.merged_repeats(r, ["i"], "ids", F.lit(2)).collect()} == {1: [0, 1], 2: [0, 1]}
    assert J.missing_cells(spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int"), ["x", "y"]).count() == 2


def test_outcomes(spark):
    df = spark.createDataFrame([(1, True, False, [], []), (2, False, True, [True, False], [True]), (3, None, None, None, None)], "k int, passed boolean, passed_plus boolean, outcomes array<boolean>, plus_outcomes array<boolean>")
    got = {r.k: r for r in P.completed_outcomes(df).collect()}
    assert (got[1].num_tests_passed, got[1].outcomes, got[1].plus_outcomes) == (1, [True], [False])
    assert got[2].num_tests_passed == 2 and got[3].num_tests_passed == 0
    with pytest.raises(Exception, match="neither"):
        df.select(P.hidden_outcome(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))).collect()
    assert df.select(P.hidden_outcome(F.lit(None).cast("boolean"), F.lit(True)).alias("x")).first().x is True


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([9],), ([],)], "x array<int>")
    assert [r.y for r in df.select(A.keep_last(F.col("x"), 3).alias("y")).collect()] == [[2, 3, 4], [9], []]
    assert [r.y for r in df.select(A.with_specials(F.col("x"), 9, 4).alias("y")).collect()] == [[9, 1, 2, 3, 4], [9, 4], [9, 4]]
    assert [r.y for r in df.select(A.padded(F.col("x"), F.lit(3), 0, left=True).alias("y")).collect()] == [[1, 2, 3, 4], [0, 0, 9], [0, 0, 0]]
    e = spark.createDataFrame([([1000.0, 1000.0], 0)], "x array<double>, i int")
    assert e.select(A.log_softmax_at(F.col("x"), F.col("i")).alias("p")).first().p == pytest.approx(np.log(0.5))


def test_templates_to_the_character(spark):
    df = spark.createDataFrame([("P", "C"), (None, "C"), ("", "C")], "p string, c string")
    t = T.TEMPLATES
    got = [r[0] for r in df.select(T.prompt(t["qsol_task"], F.col("p"), F.col("c"), newline=True)).collect()]
    assert got[0] == "# Question\nP\n\n# Proposed Solution\n```python\nC\n```\n" and got[1] == got[2] == "\n# Proposed Solution\n```python\nC\n```\n"
    assert df.select(T.prompt(t["base"], F.col("p"), F.col("c"))).first()[0] == '```python\n"""\nP\n"""\nC\n```'
    assert df.select(T.prompt(t["raw_yn"], F.col("p"), F.col("c"))).first()[0] == "P\n----------\n\nC"
    assert df.select(T.prompt(t["prob_sol_yn"], F.col("p"), F.col("c"))).first()[0] == "[PROBLEM]\nP\n[/PROBLEM]\n[SOLUTION]\n```python\nC\n```\n[/SOLUTION]"
    assert df.select(T.completion(t["qsol_task"], F.lit(True))).first()[0] == "\n# Is the solution correct (Answer [Yes]/[No])?\n[Yes]"
    assert df.select(T.prefix(t["qsol_task"], F.col("p"))).first()[0] == "# Question\nP\n\n# Proposed Solution\n```python\n"


def test_code_functions(spark):
    good, bad = "import os.path\nfrom re import x\nfrom . import y\n# c\ndef f():\n    'doc'\n    return 1", "def f(:\n  # c"
    df = spark.createDataFrame([(good,), (bad,), (None,), ("(" * 5000,)], "s string")
    assert [r[0] for r in df.select(C.valid_syntax(F.col("s"))).collect()] == [True, False, None, False]
    assert [r[0] for r in df.select(C.imports(F.col("s"))).collect()] == [["os", "re"], [], None, []]
    assert df.select(C.docstring(F.col("s"))).first()[0] == "doc"
    assert "# c" not in df.select(C.clean_code(F.col("s"))).first()[0] and C.without_comments(bad) == bad
    assert C.formatted("x") == "x\n" and "os" in C.standard_modules()


def test_text_functions(spark):
    df = spark.createDataFrame([(" \n a b \t\n",)], "s string")
    assert df.select(X.strip_ws(F.col("s"))).first()[0] == "a b"
    lit = lambda c: df.select(c).first()[0]
    assert lit(X.before_fence(F.lit("x\n```\ny"))) == "x"
    assert lit(X.as_program(F.lit("t\n```python\r\n x=1\n```\nrest "), True)) == "x=1"
    r = X.lint_report(F.lit("m.py:1:2: E0001: x\nm.py:1:2: W1: y\nYour code has been rated at -3.00/10"))
    assert (lit(r["score"]), lit(r["errors"]), lit(r["warnings"]), lit(r["fatals"])) == (None, 1, 1, 0)
    assert lit(X.model_parameters(F.lit("net-1_5b"))) == 1.5e9 and lit(X.model_parameters(F.lit("net"))) is None
    assert lit(X.clock(F.lit(3725.5))) == "01:02:05.50"


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0], [0.0, 1.0], [1, 1], True)], "p array<double>, f array<double>, m array<int>, ok boolean")
    d = SC.binary(df, F.col("p"), F.col("f"), F.col("m"))
    assert (d.first().score, d.first().failed_score, d.first().pred) == (2.0, 0.5, True)
    l = SC.losses(d, F.col("score"), F.col("failed_score"), F.col("ok")).first()
    assert l.pair_loss == pytest.approx(-1.5) and l.point_loss == pytest.approx(np.log(1 + np.exp(-1.5)))
    assert df.select(SC.pair_loss(F.lit(-800.0), F.lit(0.0)).alias("x")).first().x == pytest.approx(800)
    got = SC.score_with_model(df.select("ok"), lambda b: b.ok.astype(float)).first()
    assert got.score == 1.0
    with pytest.raises(ValueError):
        SC.scorer("none")


def test_programs_run_with_limits(spark):
    rows = [("a", "0", 0, "print(int(input()) * 2)", ["1", "2"], ["2", "4"]), ("a", "1", 0, "while True: pass", ["1"], ["2"]), ("a", "2", 0, "1/0", ["1", "1"], ["", ""]), ("a", "3", 0, None, ["1"], ["1"])]
    df = spark.createDataFrame(rows, "task_id string, sid string, trial int, solution string, inputs array<string>, outputs array<string>")
    got = {r.sid: r for r in E.executed(df, first_timeout=2, timeout=2).collect()}
    assert got["0"].passed and got["0"].num_passed == 2
    assert got["1"].timeout and not got["1"].passed
    assert got["2"].had_error and got["2"].num_ran == 1 and not got["3"].passed


def test_suites(spark):
    with pytest.raises(ValueError):
        EvalSuite("x", filter_stage="execute_3s7t")
    with pytest.raises(ValueError):
        ScoringConfig(mask_query=True, mask_problem=True)
    c = spark.createDataFrame([("mbpp/1", i, "mbpp", 0.1 * i, 0.1, i == 2, 1) for i in range(4)], "task_id string, sid int, dataset string, score double, score_time double, passed boolean, count int")
    f = c.select("task_id", "sid", (F.col("sid") != 3).alias("is_valid_syntax"), F.lit(False).alias("is_valid_syntax_timeout"))
    one = EvalSuite("one", tasks=(TaskConfig("mbpp"),), filter_stage="is_valid_syntax")
    d = run_suite(c, f, one)
    assert d.count() == 4 and d.filter("filtered_out").first().score == float("-inf")
    rep = {r.metric: r.value for r in suite_report(d, one).collect()}
    assert rep["top1"] == 100.0 and rep["pruned"] == 1.0


def test_suites_of_the_settings():
    assert {"zero_shot", "two_shot", "debug", "debug_filter", "zero_shot_syntax", "zero_shot_lint", *(f"zero_shot_3s{n}t" for n in (1, 2, 3, 4, 5, 10))} == set(SUITES)
    assert all(len(t.icl_examples) == 2 for t in SUITES["two_shot"].tasks) and SUITES["debug"].filter_stage is None


def test_programs_are_cleaned_as_their_task_says(spark):
    tasks = (TaskConfig("mbpp", remove_comments=True), TaskConfig("gsm8k", clean_solutions=True), TaskConfig("humaneval", clean_solutions=True, remove_comments=True), TaskConfig("code_contests"))
    long = "x = 1  # " + "y" * 20_000
    d = spark.createDataFrame([(t.name, long) for t in tasks], "dataset string, solution string")
    got = {r.dataset: r.solution for r in prepared(d, EvalSuite("s", tasks=tasks)).collect()}
    assert got["mbpp"] == "x = 1" and got["humaneval"] == "x = 1" and got["code_contests"] == long
    assert got["gsm8k"].endswith("\n") and "#" in got["gsm8k"]


def test_an_evaluation_from_candidates_to_files(spark, tmp_path):
    """Cleaned, rendered with the task's example, filtered before scoring, scored in batches, reported and written."""
    rows = [("humaneval/1", 0, "humaneval", "x = 1  # one", True, 1), ("humaneval/1", 1, "humaneval", "x=2", False, 2), ("humaneval/1", 2, "humaneval", "bad (", False, 1), ("mbpp/1", 0, "mbpp", "y  =  3", True, 1), ("gsm8k/1", 0, "gsm8k", "z", True, 1)]
    c = spark.createDataFrame(rows, "task_id string, sid int, dataset string, solution string, passed boolean, count int")
    f = c.select("task_id", "sid", (F.col("sid") != 2).alias("is_valid_syntax"), F.lit(False).alias("is_valid_syntax_timeout"))
    t = spark.createDataFrame([("humaneval/1", "def f():\n    'Add.'", "Add."), ("mbpp/1", "Sum it up, please.", None)], "task_id string, problem string, docstring string")
    times = spark.createDataFrame([("g", "s", "mbpp", "is_valid_syntax", 2.0), ("g", "s", "mbpp", "is_valid_syntax", 4.0), ("g", "other", "mbpp", "is_valid_syntax", 9.0)], "generator string, sampling_setup string, dataset string, filter_name string, time double")
    tasks = (TaskConfig("humaneval", remove_comments=True, icl_examples=(("P", "C", True),)), TaskConfig("mbpp"))
    s = EvalSuite("s", tasks=tasks, filter_stage="is_valid_syntax", rstrip_query=True, ks=(1,))
    seen = []

    def run(b):
        assert b["batch"].nunique() == 1 and len(b) * (b["query_tokens"].max() + 8 - b["query_tokens"].max() % 8) <= 4096 or len(b) == 1
        return pd.DataFrame({"value": [float(len(q)) for q in b["query"]], "text": list(b["query"])})

    cfg = RunConfig("g", "s", s, ScoringConfig("reward_model", 4096), PreprocessorConfig(max_problem_tokens=6))
    model = Model(run, "value double, text string", ("value",))
    done, report = evaluate(c, t, cfg, model, f, times, folder=f"{tmp_path}/out")
    got = {(r.task_id, r.sid): r for r in done.collect()}
    assert set(got) == {("humaneval/1", 0), ("humaneval/1", 1), ("humaneval/1", 2), ("mbpp/1", 0)}
    assert got["humaneval/1", 2].filtered_out and got["humaneval/1", 2].score == float("-inf") and got["humaneval/1", 2].score_time == 0
    want = "# Example 1:\n# Question\nP\n\n# Proposed Solution\n```python\nC\n```\n# Is the solution correct (Answer [Yes]/[No])?\n[Yes]\n\n# Example 2:\n# Question\nAdd.\n\n# Proposed Solution\n```python\nx = 1\n```"
    assert got["humaneval/1", 0].score == len(want) and got["humaneval/1", 0].score_time >= 0
    assert got["mbpp/1", 0].score == len("# Question\nSum it\n\n# Proposed Solution\n```python\ny  =  3\n```")
    rep = {(r.dataset, r.metric): r.value for r in report.collect()}
    assert rep["mbpp", "filtering"] == 3.0 and rep["humaneval", "pruned"] == 1.0 and rep["humaneval", "top1"] == 100.0
    doc = readers.document(spark, f"{tmp_path}/out/overall.json")
    assert doc["mbpp/filtering"] == 3.0 and list(doc) == sorted(doc) and not seen
    assert spark.read.json(f"{tmp_path}/out/results").count() == 4


def test_batches_go_on_over_arrow_batches(spark):
    df = spark.range(50).select("id", F.lit(3).alias("n")).coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = SC.score_in_batches(df, lambda b: pd.DataFrame({"size": [len(b)] * len(b)}), "size bigint", "n", "id", 80, 8, partitions=1).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 50 and (got["size"] == 10).all() and got.batch.nunique() == 5 and (got.groupby("batch").score_time.nunique() == 1).all()


def test_trials_are_run_written_and_aggregated(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "x = 1"), ("a", 1, "x ="), ("b", 0, None)], "task_id string, sid int, solution string")
    calls = str(tmp_path / "calls")

    def odd(programs):  # passes in the first trial only
        with open(calls, "a") as f:
            f.write("x" * bool(programs))
        first = len(open(calls).read()) <= 1
        return [(first, False, False, 0, 9.5, 0.25) for _ in programs]

    got = {(r.task_id, r.sid): r for r in TN.run_trials(df, TN.syntax_stage, 2, str(tmp_path / "syntax")).collect()}
    assert got["a", "0"].passed and not got["a", "1"].passed and not got["b", "0"].passed and all(r.trials == 2 and r.passed_vals is None for r in got.values())
    one = TN.run_trials(df.limit(1).coalesce(1), odd, 2, str(tmp_path / "odd")).first()
    assert one.passed_vals == "True:1|False:1" and one.execution_time == 0.25 and one.execution_time_std == 0.0
    assert readers.trial_results(spark, str(tmp_path / "odd")).count() == 2
    fake = tmp_path / "lint.py"
    fake.write_text("import sys\nt = open(sys.argv[1]).read()\nprint('x.py:1:0: E0001: no' if 'bad' in t else 'ok')\nprint('rated at 8.50/10')\n")
    stage = TN.lint_stage((sys.executable, str(fake)))
    assert [(x[0], x[4]) for x in stage(["fine", "bad", None])] == [(True, 8.5), (False, 8.5), (False, 8.5)]
    assert [x[:4] for x in TN.lint_stage(("no-such-linter",))(["fine"])] == [(False, False, True, 127)]


def test_files_there_and_back(spark, tmp_path):
    d = spark.createDataFrame([("t/1", 0, 0, 0.5, 0.1, True, None, None, -1.0, 1, 1, False), ("t/1", 1, 1, 0.7, 0.3, False, None, None, -1.0, 1, 1, False)], readers.schema("scored"))
    writers.jsonl(d, f"{tmp_path}/m/s/t.raw.jsonl.gz")
    assert readers.jsonl(spark, f"{tmp_path}/m/s/t.raw.jsonl.gz", "scored").exceptAll(d).count() == 0
    writers.sharded(d.coalesce(1), f"{tmp_path}/shards", rows=1)
    assert len([x for x in os.listdir(f"{tmp_path}/shards") if x.endswith(".json.gz")]) == 2
    writers.csv(d.select("task_id", "score"), f"{tmp_path}/c")
    writers.trial(d, str(tmp_path / "run"), 0)
    writers.trial(d, str(tmp_path / "run"), 1)
    d.write.parquet(f"{tmp_path}/run/results.parquet")
    assert readers.trial_results(spark, str(tmp_path / "run")).count() == 4
    assert writers.metrics_json(spark, spark.createDataFrame([("b", "y", 2.0), ("a", "x", 1.0)], "task string, metric string, value double"), f"{tmp_path}/m.json") == {"a/x": 1.0, "b/y": 2.0}
    row = writers.problem_scores(d, f"{tmp_path}/p").first()
    assert [s.sid for s in row.solutions] == [1, 0] and row.time_mean == pytest.approx(0.2)
    writers.splits({"train": d, "validation": d.limit(1)}, f"{tmp_path}/ds")
    assert readers.split(spark, f"{tmp_path}/ds", "validation").count() == 1
    assert readers.subset_name("a/b", "t0.8_n128", "mbpp") == "a_b_t0p8_n128_mbpp"
    with pytest.raises(ValueError):
        readers.load_benchmark(d, "none")


def test_written_steps_survive_and_vanish(spark):
    d = materialize(spark.range(5).select("id"))
    assert d.count() == 5 and os.path.isdir(d._rankloom_path)


def test_steps_are_deleted_together(spark):
    with Steps() as outer:
        a = materialize(spark.range(3))
        with Steps() as inner:
            b = materialize(spark.range(4))
    c = materialize(spark.range(5))
    inner.release()
    assert not os.path.isdir(b._rankloom_path) and a.count() == 3
    outer.release(a)
    assert a.count() == 3 and c.count() == 5


@pytest.mark.parametrize("most", [1, 3, 100])
def test_bounded_join_by_broadcast_and_by_shuffle(spark, most):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(k, 0) for k in "abcde"] + [(None, 1), (None, 2), ("alone", 3)], "k string, v int")
    right = spark.createDataFrame([("hot", 500, 1.0), ("a", 1, 2.0), ("b", 1, 3.0), (None, 2, 4.0), ("nobody", 0, 5.0)], "r string, n int, x double")
    for how in ("inner", "left"):
        got = skew.bounded_join(left, right, ["k"], ["r"], "n", how, most)
        want = left.join(right, left.k.eqNullSafe(right.r), how)
        assert sorted(map(str, got.select("k", "v", "x").collect())) == sorted(map(str, want.select("k", "v", "x").collect()))
    assert skew.bounded_join(left, right.limit(0), ["k"], ["r"], "n", "left", most).count() == left.count()


def test_grid_and_lookup(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("b", 2, 5.0), (None, 1, 9.0)], "m string, s int, t double")
    assert {(r.m, r.s): r.exists for r in J.config_grid(d, ["m", "s"]).collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): False, ("b", 2): True}
    assert {(r.m, r.s): r.t for r in J.stage_times(d, ["m", "s"], "t").collect()} == {("a", 1): 3.0, ("a", 2): None, ("b", 1): None, ("b", 2): 5.0}


def test_problems_cut_to_tokens(spark):
    d = spark.createDataFrame([("abc",), ("abcd",), ("aé中",), (None,), ("",)], "t string")
    assert [r.c for r in d.select(K.truncated_text(F.col("t"), 3).alias("c")).collect()] == ["abc", "abc", "aé", None, ""]
    upper = K.truncated_text(F.col("t"), 2, lambda texts: [[ord(c) for c in t] for t in texts], lambda ids: ["".join(map(chr, x)) for x in ids])
    assert [r.c for r in d.select(upper.alias("c")).collect()] == ["ab", "ab", "aé", None, ""]


def test_parsed_programs_part(spark):
    rows = [("a", "x = 1", True), ("a", " x = 1\n", False), ("a", "x = ", True), ("b", "if x:", True), ("b", None, True)]
    d = spark.createDataFrame(rows, "t string, s string, passed boolean")
    ok, bad = D.dedup_split_syntax(d, ["t"], X.strip_ws(F.col("s")), C.valid_syntax(F.col("text")), [])
    assert [(r.t, r.text, r["count"], r.passed) for r in ok.collect()] == [("a", "x = 1", 2, True)]
    assert {(r.t, r.text, r.passed) for r in bad.collect()} == {("a", "x =", False), ("b", "if x:", False)}


def test_stream_of_trials(spark, tmp_path):
    rows = [(0, "a", "0", False, True), (1, "a", "0", True, False), (0, "b", "0", False, False)]
    d = spark.createDataFrame(rows, "trial int, task_id string, sid string, timeout boolean, passed boolean").withColumn("finished_at", F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    d.limit(2).write.parquet(f"{tmp_path}/in/1")
    s = ST.trial_stream(spark, f"{tmp_path}/in")
    ST.keep_flags(s, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    d.subtract(d.limit(2)).write.parquet(f"{tmp_path}/in/2")
    ST.keep_flags(s, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {r.task_id: (r.passed, r.timeout) for r in ST.current_flags(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": (True, True), "b": (False, False)}
    q = ST.windowed_pass_rates(s).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").first().trials == 3
