"""Problem 3: medians and other percentiles of very many numbers per group, with a guaranteed rank error.

Method: the q-digest. Values are quantized to the leaves of a binary tree over an ordered, bounded universe; a digest
holds counts of tree nodes. Counting leaves combines on the map side. Compression moves counts that are small together
with their sibling's and parent's to the parent, so that inner nodes hold at most n / K. Digests of days or partitions
are merged by adding the counts of equal nodes; the error bound holds for the merged digest as for one made at once.

Guarantees, whatever the data: a reported percentile's rank is off by at most BITS * floor(n / K), half a percent of
n here and nothing where n < K; its value is a leaf's, which is off by at most 1 / (2 * STEPS) of the value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import materialize

#: Octaves of the universe, from 2**-64 to 2**64, and steps in each: leaves are 0.2 percent wide.
OCTAVES, STEPS = 128, 512
HALF = OCTAVES * STEPS
#: Depth of the tree; it has 2**BITS leaves, half of them for negative values.
BITS = 17
#: Compression: inner nodes hold at most n / K. A digest has at most 3 * K nodes.
K = 3400

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)

def leaf(value: Column) -> Column:
    """The leaf of a value: rises with it. Magnitudes below 2**-64 are zero, those from 2**64 on (and infinities) the outermost."""
    mag = F.abs(value)
    octave = F.least(F.greatest(F.floor(F.log2(F.least(mag, F.lit(2.0**64)))), F.lit(-64)), F.lit(63)).cast("double")
    step = F.least(F.greatest(F.floor((mag / F.pow(F.lit(2.0), octave) - 1.0) * STEPS), F.lit(0)), F.lit(STEPS - 1))
    code = F.when(mag < F.lit(2.0**-64), F.lit(0)).otherwise(F.least((octave + 64.0) * STEPS + step + 1.0, F.lit(HALF - 1))).cast("int")
    return F.when(value < 0, F.lit(HALF) - code).otherwise(F.lit(HALF) + code)


def leaf_value(index: np.ndarray) -> np.ndarray:
    """The middle of a leaf."""
    code = np.abs(index.astype(np.int64) - HALF)
    octave, step = np.divmod(np.maximum(code - 1, 0), STEPS)
    return np.where(code == 0, 0.0, np.sign(index - HALF) * np.exp2(octave - 64.0) * (1 + (step + 0.5) / STEPS))


def compress(node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digest of node counts (each node once): siblings and parent are joined wherever they hold at most n / K."""
    limit = int(count.sum()) // K
    if limit == 0 or len(node) < 2:
        order = np.argsort(node)
        return node[order], count[order]
    order = np.argsort(node)
    node, count = node[order].astype(np.int64), count[order]
    for depth in range(BITS, 0, -1):
        low, high = np.searchsorted(node, [1 << depth, 1 << (depth + 1)])
        if low == high:
            continue
        parent, first = np.unique(node[low:high] >> 1, return_index=True)
        both = np.add.reduceat(count[low:high], first)
        at = np.searchsorted(node[:low], parent)
        there = (at < low) & (node[np.minimum(at, max(low - 1, 0))] == parent) if low else np.zeros(len(parent), bool)
        up = both + np.where(there, count[np.minimum(at, max(low - 1, 0))] if low else 0, 0) <= limit
        if not up.any():
            continue
        moved = np.isin(node[low:high] >> 1, parent[up])
        count = count.copy()
        count[at[up & there]] += both[up & there]
        keep = np.ones(len(node), bool)
        keep[low:high] = ~moved
        node = np.concatenate([node[keep], parent[up & ~there]])
        count = np.concatenate([count[keep], both[up & ~there]])
        order = np.argsort(node, kind="stable")
        node, count = node[order], count[order]
    return node, count


def quantiles(node: np.ndarray, count: np.ndarray, at: tuple[float, ...]) -> np.ndarray:
    """The leaves reported for the shares ``at``: nodes in the order of their last leaf, small ones first, up to the rank."""
    node = node.astype(np.int64)
    depth = np.floor(np.log2(node)).astype(np.int64)
    last = ((node + 1) << (BITS - depth)) - 1 - (1 << BITS)
    order = np.lexsort((-depth, last))
    total = np.cumsum(count[order])
    ranks = np.maximum(1, np.ceil(np.array(at) * total[-1] - 1e-9))
    return last[order][np.searchsorted(total, ranks)]


def _compressed(nodes: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """One digest a row: the columns hold arrays, which Arrow hands over and takes as they are."""
    done = [compress(n.astype(np.int64), c) for n, c in zip(nodes, counts)]
    return pd.DataFrame({"nodes": [n.astype(np.int32) for n, _ in done], "counts": [c for _, c in done]})


def leaf_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, node, count`` of the values: at most 2**BITS rows a group, combined on the map side.

    Null and NaN are no values; a group of nothing else has no row. Infinities are the outermost values. Null keys are keys.
    Repeated rows count each time. An empty table gives no rows; other columns aren't read.
    """
    d = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    return d.groupBy(*keys, (leaf(F.col("__v")) + (1 << BITS)).alias("node")).agg(F.count(F.lit(1)).alias("count"))


def digests(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, nodes, counts``: one digest per group of node counts, as two parallel arrays. A group has at most 2**BITS node
    counts, or those of digests."""
    d = counts.groupBy(*keys).agg(F.sum("count").alias("n"), F.collect_list(F.struct("node", "count")).alias("x"))
    d = d.select(*keys, "n", F.pandas_udf(_compressed, "nodes array<int>, counts array<bigint>")("x.node", "x.count").alias("d"))
    return d.select(*keys, "n", "d.nodes", "d.counts")


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Digests combined by group, from any number of them: equal nodes are added, then compressed for the new n."""
    rows = parts.select(*keys, F.inline(F.arrays_zip("nodes", "counts")).alias("node", "count"))
    return digests(rows.groupBy(*keys, "node").agg(F.sum("count").alias("count")), keys)


def percentiles(whole: DataFrame, keys: list[str], at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``keys, n, percentile, value, leaf, rank_error`` of digests; ``rank_error`` is the most by which the rank is off."""

    @F.pandas_udf("array<struct<percentile:double,leaf:int,value:double>>")
    def ask(nodes: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for n, c in zip(nodes, counts):
            got = quantiles(n, c, at)
            out.append([{"percentile": p, "leaf": int(i), "value": float(v)} for p, i, v in zip(at, got, leaf_value(got))])
        return pd.Series(out)

    d = whole.select(*keys, "n", F.inline(ask("nodes", "counts")))
    return d.withColumn("rank_error", F.lit(BITS) * F.floor(F.col("n") / K))


KEYS = ["metric", "dataset", "generator"]


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All timings as ``metric, dataset, generator, day, value``: filters by dataset and generator, and the entries of trials."""
    f = spark.read.parquet(f"{sf_dir}/filter_timings_summary.parquet")
    f = f.select(F.concat(F.lit("filter:"), F.coalesce("filter_name", F.lit(""))).alias("metric"), "dataset", "generator", F.col("run_date").alias("day"), F.col("time").alias("value"))
    e = spark.read.parquet(f"{sf_dir}/exec_results.parquet").select(F.to_date("finished_at").alias("day"), F.explode("timing").alias("entry", "value"))
    none = F.lit(None).cast("string")
    return f.unionByName(e.select(F.concat(F.lit("trial:"), "entry").alias("metric"), none.alias("dataset"), none.alias("generator"), "day", "value"))


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial results: one digest per group and day, to be kept and combined later."""
    keys = [*KEYS, "day"]
    return digests(leaf_counts(timings(spark, sf_dir), keys, "value"), keys)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per group over all days, from the days' digests. A value delivered again counts again."""
    return percentiles(merged(p3_daily(spark, sf_dir), KEYS), KEYS)


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported percentiles held against exact ranks: per group, n and whether all keep the bound."""
    d = timings(spark, sf_dir)
    got = materialize(p3_percentiles(spark, sf_dir), "percentiles")
    exact = leaf_counts(d, KEYS, "value").toDF(*[f"x_{k}" for k in KEYS], "node", "count")
    on = [F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in KEYS]
    mine = F.col("leaf") + (1 << BITS)
    j = got.join(exact, on).groupBy(*KEYS, "percentile", "n", "rank_error")
    j = j.agg(F.sum(F.when(F.col("node") <= mine, F.col("count")).otherwise(0)).alias("le"), F.sum(F.when(F.col("node") < mine, F.col("count")).otherwise(0)).alias("lt"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("n") - 1e-9))
    ok = (F.col("le") >= rank) & (F.col("lt") <= rank - 1 + F.col("rank_error"))
    return j.groupBy(*KEYS).agg(F.max("n").alias("n"), F.bool_and(ok).alias("within_bound"))


def p3_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of groups of fewer than K values, whose ranks are exact: SQL finds the same leaves by sorting."""
    return p3_percentiles(spark, sf_dir).filter("rank_error = 0").select(*KEYS, "n", "percentile", F.round("value", 9).alias("value"))


QUERIES = {"p3_percentiles": p3_percentiles, "p3_daily": p3_daily, "p3_bounds": p3_bounds, "p3_small": p3_small}

SQL = {
    "p3_small": f"""with v as (
  select 'filter:' || coalesce(filter_name, '') metric, dataset, generator, time as x from filter_timings_summary
  union all
  select 'trial:' || e.key, null, null, e.value from (select unnest(map_entries(timing)) e from exec_results)),
r as (select *, row_number() over (partition by metric, dataset, generator order by x) i, count(*) over (partition by metric, dataset, generator) n from v where x is not null and not isnan(x)),
q as (select r.*, p from r, (select unnest({list(PERCENTILES)}) p) where n < {K} and i = greatest(1, ceil(p::double * n - 1e-9))),
o as (select *, abs(x) a, floor(log2(greatest(abs(x), 1e-18))) oct from q),
w as (select *, least(greatest(floor((a / pow(2.0, oct) - 1) * {STEPS}), 0), {STEPS - 1}) st from o)
select metric, dataset, generator, n, p::double percentile, round(case when a < pow(2.0, -64) then 0 else sign(x) * pow(2.0, oct) * (1 + (st + 0.5) / {STEPS}) end, 9) "value" from w""",
    "p3_bounds": """with v as (
  select 'filter:' || coalesce(filter_name, '') metric, dataset, generator, time as x from filter_timings_summary
  union all
  select 'trial:' || e.key, null, null, e.value from (select unnest(map_entries(timing)) e from exec_results))
select metric, dataset, generator, count(*) n, true within_bound from v where x is not null and not isnan(x) group by all"""
}
