"""Ranking metrics over scored candidates, weighted by how often each candidate was generated.

A candidate of weight ``count`` occupies the ranks ``[lo, hi)`` of its problem, ``hi - lo = count``; nothing is exploded.
All metrics are sums over these intervals, so that one pass of aggregation follows the ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.skew import bounded_join
from rankloom.session import materialize

#: Candidates of one problem whose sid agrees beyond these low bits may share a part.
SID_BITS = 12
#: Rows of a part beyond which it is split by its exact scores and by sid; and the estimated bytes of a table beyond which
#: parts of such a size are looked for. Only the plan depends on both.
HOT_ROWS, HOT_BYTES = 1_000_000, 1 << 28

NEG_INF = float("-inf")


def effective_score(score: Column) -> Column:
    """The score by which a candidate ranks: a null or NaN one ranks with the pruned, at -infinity."""
    return F.when(score.isNull() | F.isnan(score), F.lit(NEG_INF)).otherwise(score)


def _part(score: Column, sid: Column) -> tuple[Column, Column]:
    """Coarse parts in ranking order: 16 to an octave of the score, and within equal scores by the high bits of the sid."""
    mag = F.abs(score)
    octave = F.least(F.greatest(F.floor(F.log2(mag)), F.lit(-512)), F.lit(511)).cast("double")
    step = F.least(F.greatest(F.floor((mag / F.pow(F.lit(2.0), octave) - 1.0) * 16.0), F.lit(0)), F.lit(15))
    code = F.when(mag < F.lit(2.0**-512), F.lit(0)).otherwise((octave + 513.0) * 16.0 + step).cast("int")
    signed = F.when(mag == float("inf"), F.when(score > 0, 1 << 20).otherwise(-(1 << 20))).otherwise(F.when(score < 0, -code).otherwise(code))
    # only scores without a spread of their own (pruned candidates) need the sid to split them
    return -signed, F.when(score == NEG_INF, F.shiftright(F.coalesce(sid.cast("bigint"), F.lit(-1)), SID_BITS)).otherwise(0)


def input_bytes(df: DataFrame) -> int:
    """The estimated size of what a plan reads: joins aren't multiplied out, as their own estimates do."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _split_hot(d: DataFrame, keys: list[str], sid: str, hot: int) -> DataFrame:
    """``d`` with the parts of more than ``hot`` rows split further: ``__p0`` is their exact score, ``__p2`` the high bits of the sid."""
    d = materialize(d, "ranked")
    parts = ["__p1", "__p2"]
    heavy = d.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("h_rows")).filter(F.col("h_rows") > hot)
    heavy = materialize(heavy.toDF(*[f"h_{c}" for c in (*keys, *parts)], "h_rows"), "hot")
    d = bounded_join(d, heavy, [*keys, *parts], [f"h_{c}" for c in (*keys, *parts)], "h_rows", "left")
    is_hot = F.col("h_rows").isNotNull() & (F.col("eff") > NEG_INF)  # pruned candidates are split by sid already
    high = F.shiftright(F.coalesce(F.col(sid).cast("bigint"), F.lit(-1)), SID_BITS)
    return d.withColumn("__p0", F.when(is_hot, -F.col("eff"))).withColumn("__p2", F.when(is_hot, high).otherwise(F.col("__p2"))).drop("h_rows", *[f"h_{c}" for c in (*keys, *parts)])


def rank_intervals(
    df: DataFrame, keys: Sequence[str], score: str = "score", sid: str = "sid", count: str | None = "count", flags: Sequence[str] = (), hot: int = HOT_ROWS, large: bool | None = None
) -> DataFrame:
    """Adds ``eff`` (the effective score), ``w`` (the weight), ``lo`` and ``hi``, the problem's weight ``n_all``, and for each of
    ``flags`` the weight of the problem's candidates that have it (``n_<flag>``).

    Order: score descending, equal scores by sid ascending. A problem isn't ordered in one task: its candidates are cut
    into parts by score; the parts' weights are summed first, and only each part is sorted. A null or non-positive
    weight counts as 1; without ``count`` every candidate weighs 1. In a ``large`` table (by default one made from HOT_BYTES or
    more by estimate) parts of more than ``hot`` rows, such as many equal scores of one problem, are found first and split
    by score and sid.
    """
    keys = list(keys)
    w = F.lit(1).cast("bigint") if count is None else F.greatest(F.coalesce(F.col(count), F.lit(1)), F.lit(1)).cast("bigint")
    d = df.withColumn("eff", effective_score(F.col(score))).withColumn("w", w)
    p1, p2 = _part(F.col("eff"), F.col(sid))
    d = d.withColumn("__p1", p1).withColumn("__p2", p2)
    if large is None:
        large = input_bytes(df) >= HOT_BYTES
    # in parts that aren't split __p0 is null; it is joined null-safely through a value that no score has
    d = _split_hot(d, keys, sid, hot) if large else d.withColumn("__p0", F.lit(None).cast("double"))
    d = d.withColumn("__p0", F.coalesce("__p0", F.lit(float("nan"))))
    order = ["__p1", "__p0", "__p2"]
    parts = d.groupBy(*keys, *order).agg(F.sum("w").alias("__pw"), *[F.sum(F.when(F.col(f), F.col("w")).otherwise(0)).alias(f"__w_{f}") for f in flags])
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = [F.sum("__pw").over(whole).alias("n_all"), *[F.sum(f"__w_{f}").over(whole).alias(f"n_{f}") for f in flags]]
    parts = parts.select(*keys, *order, F.coalesce(F.sum("__pw").over(before), F.lit(0).cast("bigint")).alias("__before"), *totals)
    inside = Window.partitionBy(*keys, *order).orderBy(F.desc("eff"), F.asc(sid)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__run", F.sum("w").over(inside)).join(parts, [*keys, *order])
    hi = F.col("__before") + F.col("__run")
    return d.withColumn("hi", hi).withColumn("lo", hi - F.col("w")).drop(*order, "__run", "__before")


def display_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``shown``: the effective score, but for pruned candidates one below the lowest other (-11 if all are pruned)."""
    least = df.groupBy(*keys).agg(F.min(F.when(F.col("eff") > NEG_INF, F.col("eff"))).alias("__least"))
    out = df.join(least, list(keys))
    return out.withColumn("shown", F.when(F.col("eff") > NEG_INF, F.col("eff")).otherwise(F.coalesce(F.col("__least") - 1, F.lit(-11.0)))).drop("__least")


def survival(m: Column, n: Column, k: int) -> Column:
    """C(m, k) / C(n, k): the chance that k drawn of n all come from m of them. 0 for m < k; n must be at least k."""
    return F.when(m >= k, F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, j: acc * ((m - j) / (n - j)))).otherwise(F.lit(0.0))


#: Largest k whose products are written out, which compiles to plain arithmetic: 16 factors of any bigint are a double still.
WRITTEN_OUT = 16


def best_of_k(lo: str, hi: str, n: str, k: int, faithful: bool = True) -> Column:
    """The chance that the best-ranked of k drawn candidates is one of those at the ranks from ``lo`` to ``hi`` (SQL expressions);
    its sum over passing candidates is best-of-k. 0 where k > n.

    ``faithful`` leaves out the last possible rank, n - k, as the published figures do; otherwise it is counted.
    """
    last = f"({n} - {k})" if faithful else n
    above, below = f"({n} - {lo})", f"({n} - least({hi}, {last}))"
    if k <= WRITTEN_OUT:
        product = lambda m: "(" + " * ".join(f"(cast({m} as double) - {j}d)" for j in range(k)) + ")"
        ways = lambda m: f"if({m} >= {k}, {product(m)}, 0d)"
        part = f"({ways(above)} - {ways(below)}) / {product(n)}"
    else:
        chance = lambda m: f"if({m} >= {k}, aggregate(sequence(0, {k - 1}), 1d, (a, j) -> a * (({m} - j) / ({n} - j))), 0d)"
        part = f"{chance(above)} - {chance(below)}"
    return F.expr(f"if({n} >= {k} and {lo} < {last}, {part}, 0d)")


def _sums(flag: str, ks: Sequence[int], at: str) -> dict[str, tuple]:
    """What the metrics of one kind of outcome are made from: by name the sum over candidates, and how sums combine."""
    lo, hi, p, r = F.col("lo"), F.col("hi"), F.coalesce(F.col(flag), F.lit(False)), F.col(f"n_{flag}")
    inside = F.when(p, F.greatest(F.least(hi, r) - lo, F.lit(0))).otherwise(0)
    out = {
        f"{at}r": (F.first(r), F.first),
        f"{at}__in": (F.sum(inside), F.sum),
        f"{at}__first": (F.min(F.when(p, lo)), F.min),
        f"{at}top1": (F.bool_or(p & (lo == 0)), F.bool_or),
    }
    return out | {f"{at}b_of_{k}": (F.sum(F.when(p, F.col(f"__best_{k}")).otherwise(0.0)), F.sum) for k in ks}


def _finished(d: DataFrame, strict: bool, at: str) -> DataFrame:
    r, first = F.col(f"{at}r"), F.col(f"{at}__first")
    rs = F.when(r <= (1 if strict else 0), 0.0).otherwise(F.try_divide(F.col(f"{at}__in"), r))
    mrr = F.when(first.isNotNull(), 1.0 / (first + 1)).otherwise(0.0)
    return d.withColumn(f"{at}rs", rs).withColumn(f"{at}mrr", mrr).withColumn(f"{at}top1", F.col(f"{at}top1").cast("double")).drop(f"{at}__in", f"{at}__first")


def category_metrics(ranked: DataFrame, keys: Sequence[str], categories: dict[str, tuple[str, Sequence[int]]], strict: bool = True, ties: bool = False, pruned: str | None = None) -> DataFrame:
    """Per problem ``n, unique_preds`` and, for every category of outcomes, ``r, rs, mrr, top1`` and its ``b_of_k``, each with the
    category's name before it, in one aggregation.

    ``categories`` maps that name (it may be empty) to the outcome's column and the ks; ``ranked`` has the columns among its
    flags. ``ties`` adds ``num_collisions``, the scores held by more than one candidate, and ``pruned`` the number of candidates
    that have that flag.
    """
    keys = list(keys)
    # what a candidate adds to best-of-k doesn't depend on the category
    ranked = ranked.withColumns({f"__best_{k}": best_of_k("lo", "hi", "n_all", k, strict) for k in sorted({k for _, ks in categories.values() for k in ks})})
    sums = {"n": (F.first("n_all"), F.first), "unique_preds": (F.count(F.lit(1)), F.sum)}
    for at, (flag, ks) in categories.items():
        sums |= _sums(flag, ks, at)
    if pruned:
        sums["pruned"] = (F.count_if(F.col(pruned)), F.sum)
    if ties:  # sums by score first; the second step sees scores, not candidates
        per = ranked.groupBy(*keys, "eff").agg(F.sum("w").alias("__held"), *[x.alias(c) for c, (x, _) in sums.items()])
        out = per.groupBy(*keys).agg(F.count_if(F.col("__held") > 1).alias("num_collisions"), *[again(c).alias(c) for c, (_, again) in sums.items()])
    else:
        out = ranked.groupBy(*keys).agg(*[x.alias(c) for c, (x, _) in sums.items()])
    for at in categories:
        out = _finished(out, strict, at)
    return out


def problem_metrics(ranked: DataFrame, keys: Sequence[str], passed: str = "passed", ks: Sequence[int] = (4, 16, 64), strict: bool = True, ties: bool = False, pruned: str | None = None) -> DataFrame:
    """Per problem: ``n, r, unique_preds, rs, mrr, top1`` and ``b_of_k`` for each k.

    ``rs`` is the share of passing candidates among the first R ranks, R the weight of passing ones; with ``strict`` it is
    0 for R = 1, as in the published figures. A null outcome counts as not passed. Where ``ranked`` was made with ``passed``
    among its flags, nothing is joined. ``ties`` and ``pruned`` as for ``category_metrics``.
    """
    keys = list(keys)
    if f"n_{passed}" not in ranked.columns:
        weight = F.sum(F.when(F.coalesce(F.col(passed), F.lit(False)), F.col("w")).otherwise(0))
        ranked = ranked.join(ranked.groupBy(*keys).agg(weight.alias(f"n_{passed}")), keys)
    return category_metrics(ranked, keys, {"": (passed, ks)}, strict, ties, pruned)


def macro_average(per_problem: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The mean over problems of each metric; nulls are left out, not counted as 0."""
    return per_problem.groupBy(*by).agg(F.count(F.lit(1)).alias("problems"), *[F.avg(m).alias(m) for m in metrics])


def largest_ks(per_problem: DataFrame, ks: Sequence[int]) -> list[int]:
    """The ks up to the largest number of unique candidates of a problem; that number alone if none is."""
    most = per_problem.agg(F.max("unique_preds")).first()[0] or 0
    return [k for k in ks if k <= most] or [most]


def _discount(lo: str, hi: str) -> Column:
    """Sum of 1 / log2(i + 2) over the ranks of an interval, however long: up to 128 terms one by one, the rest by the
    Euler-Maclaurin formula from rank 64 on, where its next term is below 1e-9. Takes SQL expressions.

    The integral of 1 / log2(x) is taken over u = ln x in pieces of at most one, with eight Gauss points each.
    """
    direct = f"if({hi} - least({hi}, greatest({lo}, 64L)) <= 64, {hi}, least({hi}, greatest({lo}, 64L)))"
    head = f"if(d > {lo}, aggregate(sequence({lo}, d - 1), 0d, (a, i) -> a + 1d / log2(i + 2d)), 0d)"
    points, weights = np.polynomial.legendre.leggauss(8)
    at = [f"(u0 + (u1 - u0) / n * (j + {float((1 + p) / 2)!r}d))" for p in points]
    area = f"aggregate(sequence(0, n - 1), 0d, (a, j) -> a + {' + '.join(f'{float(w)!r}d * exp({u}) / {u}' for u, w in zip(at, weights))}) * (u1 - u0) / n / 2d"
    slope = lambda u: f"1d / (exp({u}) * {u} * {u})"
    tail = f"ln(2d) * ({area} - (1d / u1 - 1d / u0) / 2d - ({slope('u1')} - {slope('u0')}) / 12d)"
    named = lambda value, name, inner: f"transform(array({value}), {name} -> {inner})[0]"
    tail = named("ln(d + 2d)", "u0", named(f"ln({hi} + 2d)", "u1", named("cast(ceil(u1 - u0) as int)", "n", tail)))
    return F.expr(named(direct, "d", f"{head} + if({hi} > d, {tail}, 0d)"))


def ndcg(ranked: DataFrame, keys: Sequence[str], gain: str = "num_tests_passed", k: int | None = None, sid: str = "sid") -> DataFrame:
    """Per problem ``ndcg`` in percent: linear gains, equal scores share their mean gain, the ideal order ignores ties.

    Null gains are 0; a problem without gain has 0. ``k`` cuts both sums after k ranks. Candidates are summed by score and by
    gain; discounts are taken of whole intervals of ranks, so that no candidate is visited by rank.
    """
    keys = list(keys)
    cap = (lambda c: F.least(c, F.lit(k).cast("bigint"))) if k else (lambda c: c)
    g = F.coalesce(F.col(gain), F.lit(0)).cast("double")
    # each candidate counts with those of its score (side 0) and with those of its gain (side 1)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("eff").alias("value")), F.struct(F.lit(1).alias("side"), g.alias("value")))
    d = ranked.select(*keys, g.alias("g"), "w", "lo", "hi", F.explode(sides).alias("s")).select(*keys, "g", "w", "lo", "hi", "s.*")
    d = d.groupBy(*keys, "side", "value").agg(F.sum("w").alias("w"), F.sum(F.col("g") * F.col("w")).alias("gw"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # the ideal order of candidates of equal gain doesn't matter: one interval for each gain. Scores need no order here
    apart = F.when(F.col("side") == 0, F.pmod(F.xxhash64("value"), F.lit(256)))
    upto = F.sum("w").over(Window.partitionBy(*keys, "side", apart).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("upto", upto)
    ideal = F.col("side") == 1
    lo, hi = F.when(ideal, F.col("upto") - F.col("w")).otherwise(F.col("lo")), F.when(ideal, F.col("upto")).otherwise(F.col("hi"))
    d = d.select(*keys, "side", F.try_divide("gw", "w").alias("mean"), cap(lo).alias("lo"), cap(hi).alias("hi"))
    part = F.col("mean") * _discount("lo", "hi")
    out = d.withColumn("part", part).groupBy(*keys).agg(F.sum(F.when(~ideal, F.col("part"))).alias("dcg"), F.sum(F.when(ideal, F.col("part"))).alias("idcg"))
    return out.select(*keys, F.when(F.col("idcg") > 0, 100 * F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The chance that at least one of k drawn of n candidates passes when c pass; 1 where fewer than k fail; null where
    n < 1. The product has k factors, however large n and c are."""
    return F.when(n >= 1, F.when(n - c < k, 1.0).otherwise(1.0 - survival(n - c, n, k)))


def collisions(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per problem: scores held by more than one candidate after weighting; all pruned ones share one score."""
    per = ranked.groupBy(*keys, "eff").agg(F.sum("w").alias("c"), F.count(F.lit(1)).alias("u"))
    return per.groupBy(*keys).agg(F.count_if(F.col("c") > 1).alias("num_collisions"), F.sum("u").alias("unique_preds"))


def timing_stats(df: DataFrame, keys: Sequence[str], time: str = "score_time", pruned: str = "filtered_out") -> DataFrame:
    """Per problem over candidates that weren't pruned: mean, exact median, population deviation and sum; null if none.

    The median is the mean of the one or two middle values of the ranking by time, which no task has whole.
    """
    keys = list(keys)
    kept = df.filter(~F.coalesce(F.col(pruned), F.lit(False)) & F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias("t"))
    stats = df.groupBy(*keys).agg(F.lit(1).alias("__one")).drop("__one").join(kept.groupBy(*keys).agg(F.avg("t").alias("time_mean"), F.stddev_pop("t").alias("time_std"), F.sum("t").alias("time_sum")), keys, "left")
    ranked = rank_intervals(kept.withColumn("sid", F.lit(0)), keys, "t", count=None)
    middle = (F.col("lo") == F.floor((F.col("n_all") - 1) / 2)) | (F.col("lo") == F.floor(F.col("n_all") / 2))
    median = ranked.filter(middle).groupBy(*keys).agg(F.avg("t").alias("time_median"))
    return stats.join(median, keys, "left").select(*keys, "time_mean", "time_median", "time_std", "time_sum")


def long_form(wide: DataFrame, by: Sequence[str], categories: dict[str, tuple[str, Sequence[int]]], metrics: Sequence[str] = ("rs", "mrr", "top1")) -> DataFrame:
    """``by, category, metric, value`` of the columns that ``category_metrics`` names, one row for each."""
    cells = [(c, m) for c, (_, ks) in categories.items() for m in (*metrics, *[f"b_of_{k}" for k in ks])]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), F.col(f"{c}{m}").cast("double").alias("value")) for c, m in cells])
    return wide.select(*by, F.inline(rows))


def fan_out(metrics: Column | Sequence[str], per_problem: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Long form of the metrics of several outcome categories: ``keys, category, metric, value``."""
    out = None
    for category, d in per_problem.items():
        long = d.unpivot(list(keys), [m for m in metrics if m in d.columns], "metric", "value").withColumn("category", F.lit(category))
        out = long if out is None else out.unionByName(long)
    return out


def majority_vote(df: DataFrame, keys: Sequence[str], text: str, logprob: str, completion: str, passed: str, count: str | None = None) -> DataFrame:
    """Per problem, the outcome of the text generated most often (the smaller completion first).

    Candidates with the same text are one; its outcome is that of the last one visited by falling logprob, at equal
    logprobs of the largest completion. Also ``majority_rank``, the smallest completion of that text plus one.
    """
    keys = list(keys)
    w = F.lit(1) if count is None else F.coalesce(F.col(count), F.lit(1))
    lp = F.coalesce(F.col(logprob), F.lit(NEG_INF))
    groups = df.groupBy(*keys, text).agg(F.sum(w).alias("votes"), F.min(completion).alias("first"), F.min_by(passed, F.struct(lp, -F.col(completion))).alias("ok"))
    best = F.max_by(F.struct("votes", "first", "ok"), F.struct("votes", -F.col("first")))
    return groups.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.ok").alias("majority_passed"), (F.col("b.first") + 1).alias("majority_rank"), F.col("b.votes").alias("majority_votes"))


def selection_ranks(df: DataFrame, keys: Sequence[str], position: str, logprob: str, passed: str, count: str | None = None) -> DataFrame:
    """Per problem: ``oracle`` (any passes), ``num_passed`` (weights of passing ones), ``logprob_passed`` (outcome of the most
    likely), and ``lp_first_pass_pos``: the 1-based generation position of the most likely passing candidate, one past
    the last if none passes."""
    w = F.lit(1) if count is None else F.coalesce(F.col(count), F.lit(1))
    p = F.coalesce(F.col(passed), F.lit(False))
    order = F.struct(F.coalesce(F.col(logprob), F.lit(NEG_INF)), -F.col(position))
    return df.groupBy(*keys).agg(
        F.bool_or(p).alias("oracle"),
        F.sum(F.when(p, w).otherwise(0)).alias("num_passed"),
        F.max_by(p, order).alias("logprob_passed"),
        F.coalesce(F.max_by(F.when(p, F.col(position)), F.when(p, order)), F.count(F.lit(1))).alias("__pos"),
    ).withColumn("lp_first_pass_pos", F.col("__pos") + 1).drop("__pos")
