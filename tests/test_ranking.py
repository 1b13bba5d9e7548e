"""The ranking metrics against a plain reading of their definitions."""

import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import filters as FI
from rankloom.operators import ranking as R

SCHEMA = "task_id string, sid int, score double, passed boolean, count int, num_tests_passed int, score_time double, filtered_out boolean"
NEG = float("-inf")


def expand(rows):
    eff = lambda r: NEG if r[2] is None or r[2] != r[2] else r[2]
    out = []
    for r in sorted(rows, key=lambda r: (-eff(r), r[1])):
        out += [(bool(r[3]), r[5] or 0, eff(r))] * max(1, r[4] or 1)
    return out


def plain(rows, ks, strict=True):
    x = expand(rows)
    p, n = [a for a, _, _ in x], len(x)
    r = sum(p)
    m = {"n": n, "r": r, "unique_preds": len(rows)}
    m["rs"] = 0.0 if r <= (1 if strict else 0) else sum(p[:r]) / r
    m["mrr"] = next((1 / (i + 1) for i, a in enumerate(p) if a), 0.0)
    m["top1"] = float(p[0])
    for k in ks:
        last = n - k if strict else n - k + 1
        m[f"b_of_{k}"] = sum(math.comb(n - i - 1, k - 1) / math.comb(n, k) for i in range(max(0, last)) if p[i]) if k <= n else 0.0
    gains = [g for _, g, _ in x]
    ties: dict = {}
    for i, (_, g, s) in enumerate(x):
        ties.setdefault(s, []).append((i, g))
    d = lambda i: 1 / math.log2(i + 2)
    dcg = sum(sum(g for _, g in t) / len(t) * sum(d(i) for i, _ in t) for t in ties.values())
    ideal = sum(g * d(i) for i, g in enumerate(sorted(gains, reverse=True)))
    m["ndcg"] = 100 * dcg / ideal if ideal else 0.0
    m["num_collisions"] = sum(len(t) > 1 for t in ties.values())
    return m


def groups():
    rng = random.Random(5)
    out = {
        "none": [(i, 0.1 * i, False, 1, i) for i in range(5)],
        "one": [(i, 0.1 * i, i == 3, 1, i) for i in range(5)],
        "all": [(i, 0.1 * i, True, 2, i) for i in range(5)],
        "n_is_k": [(i, 0.1 * i, i % 2 == 0, 1, 0) for i in range(4)],
        "single": [(0, 0.5, True, 1, 3)],
        "pruned": [(i, NEG, i == 1, 1, i) for i in range(6)],
        "mixed": [(i, None if i == 2 else float("nan") if i == 3 else NEG if i == 4 else 0.5, i % 3 == 0, 1 + i % 3, 5 - i) for i in range(9)],
        "ties": [(i, 0.25 * (i // 4), i % 5 == 0, 1, i % 4) for i in range(20)],
        "negative": [(i, -1.5 * i, i in (1, 7), None if i == 2 else 3, None if i == 1 else 2) for i in range(9)],
    }
    for j in range(6):
        out[f"r{j}"] = [(i, rng.choice([rng.gauss(0, 3), 0.5, 0.0, None]), rng.random() < 0.4, rng.choice([1, 1, 2, 7]), rng.randrange(9)) for i in range(rng.randrange(1, 60))]
    return {k: [(k, s, sc, p, c, g, 0.1, False) for s, sc, p, c, g in v] for k, v in out.items()}


@pytest.mark.parametrize("strict", [True, False])
def test_metrics_equal_their_definitions(spark, strict):
    g = groups()
    df = spark.createDataFrame([r for v in g.values() for r in v], SCHEMA)
    ranked = R.rank_intervals(df, ["task_id"]).cache()
    got = R.problem_metrics(ranked, ["task_id"], ks=(2, 4), strict=strict).join(R.ndcg(ranked, ["task_id"]), "task_id").join(R.collisions(ranked, ["task_id"]).drop("unique_preds"), "task_id")
    got = {r["task_id"]: r.asDict() for r in got.collect()}
    assert set(got) == set(g)
    for k, rows in g.items():
        for name, value in plain(rows, (2, 4), strict).items():
            assert got[k][name] == pytest.approx(value, abs=1e-9), (k, name)


def test_one_problem_of_many_equal_scores_is_split(spark):
    """Hot parts are split by score and sid; the ranks stay those of the plain order."""
    rows = [r for v in groups().values() for r in v] + [("hot", i, 0.75 if i % 7 else 0.76, i % 5 == 0, 1, i % 3, 0.1, False) for i in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain_ = {(r.task_id, r.sid): (r.lo, r.hi, r.n_passed) for r in R.rank_intervals(df, ["task_id"], flags=["passed"]).collect()}
    split = R.rank_intervals(df, ["task_id"], flags=["passed"], hot=50, large=True)
    assert {(r.task_id, r.sid): (r.lo, r.hi, r.n_passed) for r in split.collect()} == plain_
    assert plain_["hot", 7][0] == 1 and plain_["hot", 1][0] == sum(i % 7 == 0 for i in range(9000))


def test_a_problem_of_a_million_equal_scores(spark):
    df = spark.range(1_000_000).select(F.lit("p").alias("task_id"), F.col("id").cast("int").alias("sid"), F.lit(0.5).alias("score"), (F.pmod("id", F.lit(10)) == 9).alias("passed"), F.lit(1).alias("count"), F.lit(1).alias("num_tests_passed"))
    ranked = R.rank_intervals(df, ["task_id"], flags=["passed"], hot=10_000, large=True)
    m = R.problem_metrics(ranked, ["task_id"], ks=(2,), ties=True).first()
    assert (m.n, m.r, m.unique_preds, m.num_collisions) == (1_000_000, 100_000, 1_000_000, 1)
    assert m.mrr == 0.1 and m.rs == 0.1 and m.top1 == 0.0 and abs(m.b_of_2 - 0.1) < 1e-4
    assert R.ndcg(ranked, ["task_id"]).first().ndcg == pytest.approx(100.0)


def test_discounts_of_long_intervals(spark):
    spans = [(0, 0), (0, 1), (0, 64), (0, 65), (3, 129), (60, 200), (0, 5000), (70, 100_000), (999, 1_000_000), (64, 193)]
    df = spark.createDataFrame(spans, "lo bigint, hi bigint")
    for r in df.select("lo", "hi", R._discount("lo", "hi").alias("d")).collect():
        assert r.d == pytest.approx(sum(1 / math.log2(i + 2) for i in range(r.lo, r.hi)), rel=1e-10, abs=1e-12)


def test_medians_by_rank(spark):
    rng = random.Random(8)
    rows = [(g, i, t, rng.random() < 0.1) for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 40)) for i, t in enumerate(rng.choice([0.0, -1.5, rng.random(), None]) for _ in range(n))] + [("e", 0, 1.0, True)]
    df = spark.createDataFrame(rows, "task_id string, sid int, score_time double, filtered_out boolean")
    got = {r.task_id: r for r in R.timing_stats(df, ["task_id"]).collect()}
    for g in "abcde":
        t = [x for a, _, x, out in rows if a == g and not out and x is not None]
        assert (got[g].time_median is None and not t) or got[g].time_median == pytest.approx(statistics.median(t))


def test_shown_scores_of_pruned_candidates(spark):
    df = spark.createDataFrame([r for v in groups().values() for r in v], SCHEMA)
    got = {(r.task_id, r.sid): r.shown for r in R.display_score(R.rank_intervals(df, ["task_id"]), ["task_id"]).collect()}
    assert got["pruned", 3] == -11.0
    assert got["mixed", 2] == got["mixed", 4] == -0.5
    assert got["ties", 19] == 1.0


def test_pass_at_k_and_its_edges(spark):
    rows = [(n, c) for n in (1, 2, 5, 40) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "n bigint, c bigint")
    for k in (1, 3, 10):
        for r in df.select("n", "c", R.pass_at_k(df.n, df.c, k).alias("p")).collect():
            want = 1.0 if r.n - r.c < k else 1 - math.prod(1 - k / j for j in range(r.n - r.c + 1, r.n + 1))
            assert r.p == pytest.approx(want, abs=1e-12)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.problem_metrics(R.rank_intervals(df, ["task_id"]), ["task_id"]).count() == 0


def test_selection(spark):
    rows = [("a", 0, "x", -1.0, True, 1), ("a", 1, "y", -0.5, False, 1), ("a", 2, "x", -2.0, False, 1), ("b", 0, "z", None, False, 2), ("c", 0, "u", -1.0, True, 1), ("c", 1, "v", -1.0, False, 1)]
    df = spark.createDataFrame(rows, "t string, pos int, s string, lp double, ok boolean, n int")
    maj = {r.t: r for r in R.majority_vote(df, ["t"], "s", "lp", "pos", "ok").collect()}
    assert maj["a"].majority_votes == 2 and maj["a"].majority_passed is False and maj["a"].majority_rank == 1
    sel = {r.t: r for r in R.selection_ranks(df, ["t"], "pos", "lp", "ok").collect()}
    assert (sel["a"].oracle, sel["a"].logprob_passed, sel["a"].lp_first_pass_pos, sel["a"].num_passed) == (True, False, 1, 1)
    assert (sel["b"].oracle, sel["b"].lp_first_pass_pos) == (False, 2)
    assert sel["c"].logprob_passed is True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.booleans(), st.integers(1, 4)), min_size=1, max_size=30))
def test_definitions_stay_in_bounds(rows):
    m = plain([("t", i, s, p, c, 1, 0.0, False) for i, (s, p, c) in enumerate(rows)], (2, 3))
    assert all(0 <= m[k] <= 1 for k in ("rs", "mrr", "b_of_2", "b_of_3")) and 0 <= m["ndcg"] <= 100 + 1e-9


def test_staged_filter(spark):
    c = spark.createDataFrame([("m/1", 0, "mbpp", 0.3), ("m/1", 1, "mbpp", 0.4), ("m/1", 2, "mbpp", 0.5), ("g/1", 0, "gsm8k", 0.1)], "task_id string, sid int, dataset string, score double")
    f = spark.createDataFrame([("m/1", 0, True, False), ("m/1", 1, False, True), ("m/1", 2, False, False)], "task_id string, sid int, e3s1t boolean, e3s1t_timeout boolean")
    keep = lambda **k: {(r.task_id, r.sid): r.keep for r in FI.staged_filter(c, f, ["task_id", "sid"], "execute_3s1t", missing="prune", **k).collect()}
    assert keep() == {("m/1", 0): True, ("m/1", 1): True, ("m/1", 2): False, ("g/1", 0): True}
    assert keep(remove_timeouts=True)["m/1", 1] is False
    with pytest.raises(Exception, match="without flag"):
        FI.staged_filter(c, f.limit(1), ["task_id", "sid"], "e3s1t").collect()
    kept, pruned = FI.split_kept(FI.staged_filter(c, f, ["task_id", "sid"], "execute_3s1t", missing="prune"))
    assert kept.count() + pruned.count() == c.count()
