"""Problem 5: the N best items of every group, with a consistent tie rule.

Method: a score histogram per group gives a lower threshold that is safe (at least N different items reach it); rows
below it are dropped before anything is moved, and the survivors are ranked exactly.

Every group of more than ``GAIN * N`` rows has a histogram; smaller ones have nothing to gain, as a histogram would move as
many rows as they have. Bins are parts of the octaves of the score, so they need no range beforehand; the larger the
group, the finer they are. Deliveries of one item repeat, so a bin doesn't count rows but holds a bit map of its items'
hashes: the set bits, taken together over the bins from the top, are a number of different items that is surely reached.
Histograms are folded to one threshold a group where they are made; only thresholds are moved further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.skew import bounded_join
from rankloom.session import materialize

#: Groups of more than so many rows for each item wanted have a histogram.
GAIN = 16
#: Finest bins to an octave, as a power of two; and the coarsest, which groups of up to COARSE_ROWS rows have.
FINE_BITS, COARSE_BITS, COARSE_ROWS = 8, 2, 1000
#: Items that one integer of the bit map can prove, with room for hashes that meet.
PER_WORD = 24


def score_bin(score: Column) -> Column:
    """An integer that never falls as the score rises; -infinity has the lowest, infinity the highest."""
    steps = float(1 << FINE_BITS)
    mag = F.abs(score)
    octave = F.least(F.greatest(F.floor(F.log2(mag)), F.lit(-1000)), F.lit(1023)).cast("double")
    step = F.least(F.greatest(F.floor((mag / F.pow(F.lit(2.0), octave) - 1.0) * steps), F.lit(0)), F.lit(steps - 1))
    code = F.when(mag < F.lit(2.0**-1000), F.lit(0)).otherwise((octave + 1001.0) * steps + step).cast("int")
    top = F.lit(1 << 20)
    return F.when(mag == F.lit(float("inf")), F.when(score > 0, top).otherwise(-top)).otherwise(F.when(score < 0, -code).otherwise(code))


def sizes(d: DataFrame, names: list[str], least: int) -> DataFrame:
    """``g_<key>, g_rows, g_shift`` of the groups of more than ``least`` rows: how far their bins are coarsened."""
    rows = F.col("g_rows")
    finer = F.floor(F.log2(F.greatest(rows / COARSE_ROWS, F.lit(1.0)))).cast("int")
    per = d.groupBy(*[F.col(a).alias(f"g_{a}") for a in names]).agg(F.count(F.lit(1)).alias("g_rows")).filter(rows > least)
    return per.withColumn("g_shift", F.greatest(F.lit(0), F.lit(FINE_BITS - COARSE_BITS) - finer))


def thresholds(d: DataFrame, large: DataFrame, names: list[str], n: int, most: int | None = None) -> DataFrame:
    """``f_<key>, f_rows, f_shift, f_floor``: the coarsened bin that at least ``n`` different items of the group reach.

    ``d`` has the keys, ``item`` and ``__bin``; ``large`` (written) is what ``sizes`` gives. A group that can't prove ``n`` items
    has no row.
    """
    words = -(-n // PER_WORD)
    own = [f"g_{a}" for a in names]
    rows = bounded_join(d, large, names, own, "g_rows", most=most)
    h = F.pmod(F.xxhash64("item"), F.lit(64 * words))
    bit = F.expr("shiftleft(1L, cast(h % 64 as int))")
    rows = rows.select(*own, "g_rows", "g_shift", F.expr("shiftright(__bin, g_shift)").alias("b"), h.alias("h"))
    maps = [F.bit_or(F.when(F.floor(F.col("h") / 64) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}") for i in range(words)]
    hist = rows.groupBy(*own, "g_rows", "g_shift", "b").agg(*maps)
    above = Window.partitionBy(*own).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    proven = sum((F.bit_count(F.bit_or(f"w{i}").over(above)) for i in range(1, words)), F.bit_count(F.bit_or("w0").over(above)))
    hist = hist.select(*own, "g_rows", "g_shift", "b", proven.alias("proven"))
    per = hist.filter(F.col("proven") >= n).groupBy(*own, "g_rows", "g_shift").agg(F.max("b").alias("f_floor"))
    return per.select(*[F.col(f"g_{a}").alias(f"f_{a}") for a in names], F.col("g_rows").alias("f_rows"), F.col("g_shift").alias("f_shift"), "f_floor")


def top_n_per_group(df: DataFrame, keys: list[str], score: str, item: str, n: int, gain: int = GAIN, most: int | None = None) -> DataFrame:
    """The ``n`` items of highest score of each group: the keys, ``item``, ``score`` and ``rank`` (1 to n).

    * Rows with the same keys and item are one item; it has its highest score.
    * Equal scores rank by the smaller item; a null item comes after all others of its score.
    * Null and NaN scores take no part; -infinity is the lowest score and takes part. -0.0 equals 0.0.
    * A null key is a group like any other. Groups with fewer items give them all; an empty table gives no rows.
    * Other columns of ``df`` are not read, so their names may clash with nothing.

    ``gain`` (rows for each item wanted from which a group has a histogram) and ``most`` (thresholds that are broadcast; the
    others reach their rows by a shuffle) change the plan, never the result.
    """
    names = [f"k{i}" for i in range(len(keys))]
    d = df.select(*[df[k].alias(a) for k, a in zip(keys, names)], df[item].alias("item"), (df[score].cast("double") + F.lit(0.0)).alias("score"))
    d = d.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    large = materialize(sizes(d, names, gain * n), "p5-sizes")
    binned = d.withColumn("__bin", score_bin(F.col("score")))
    floor = materialize(thresholds(binned, large, names, n, most), "p5-floors")
    kept = bounded_join(binned, floor, names, [f"f_{a}" for a in names], "f_rows", "left", most)
    kept = kept.filter(F.col("f_floor").isNull() | F.expr("shiftright(__bin, f_shift) >= f_floor"))
    best = kept.groupBy(*names, "item").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*names).orderBy(F.desc("score"), F.asc_nulls_last("item"))
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.select(*[F.col(a).alias(k) for a, k in zip(names, keys)], F.col("item").alias(item), F.col("score").alias(score), "rank")


def p5_top(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/scored_solutions.parquet")
    return top_n_per_group(d, ["task_id"], "score", "sid", 5)


def p5_found(spark, sf_dir: str) -> DataFrame:
    return p5_top(spark, sf_dir).select("task_id", "sid")


QUERIES = {"p5_found": p5_found, "p5_top": p5_top}

_TOP = """with c as (select task_id, sid, max(score) score from scored_solutions
  where score is not null and not isnan(score) group by 1, 2),
r as (select *, row_number() over (partition by task_id order by score desc, sid) rank from c)
select task_id, sid{more} from r where rank <= 5"""

SQL = {"p5_found": _TOP.format(more=""), "p5_top": _TOP.format(more=", score, rank")}
