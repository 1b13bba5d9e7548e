"""Problem 8: a mix of sources at target shares of the total tokens.

Method: a low-discrepancy schedule. Slot k of the mix belongs to the source in whose part of the cumulative weights the
k-th van der Corput point lies, so that every stretch of the mix, not only the whole, has the target shares. The slots of a
source are ranked. The documents of a source are shuffled by hash and laid end to end by tokens, as often as they may be
repeated; slot r of the source takes the documents that begin in its r-th block of equal tokens. No document is split, so
a source's tokens are right to within one document.

The schedule is never a table. The points of a source are the whole numbers of an interval with their bits mirrored, and how
many of them come before a slot is a sum of one quotient a bit; so the slot of rank r is found bit by bit, for any number of
slots and sources.

Unless a size is given, the mix is the largest in which no source runs out. In a larger one a source whose documents are
spent falls short, and the report says by how much. A source with a target but without documents can't be filled: its
share goes to the others in proportion, and the report says so. Document sources without a target aren't used.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.bpe import encoded, read_ranks
from rankloom.operators.skew import MAX_BROADCAST, bounded_join
from rankloom.session import materialize

#: Tokens wanted for a slot; the schedule has a power of two of slots, at least 2**LEAST_BITS. The points of up to 2**MOST_BITS
#: slots (4.6e18 tokens) are whole numbers of a double.
SLOT_TOKENS, LEAST_BITS, MOST_BITS = 1024, 12, 52
#: Leading bits of the shuffle hash that cut a source into parts. Running sums go over the parts first, then within each,
#: so that no task orders a whole source.
PART_BITS = 12

PLAN = "source string, target_share double, max_repeats int, source_tokens bigint, documents bigint, reachable_share double, first bigint, slots bigint"


def nth_slot(rank: np.ndarray, first: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    """The slot of rank ``rank`` among those whose point, ``bits`` mirrored bits, lies in ``first`` and the ``slots - 1`` numbers
    after it. From the highest bit of the slot down: are there enough such slots with a 0 here?"""
    last, left = first + slots - 1, rank.astype(np.int64)
    slot, mirrored = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for i in range(bits):
        zero = ((last - mirrored) >> (i + 1)) - ((first - 1 - mirrored) >> (i + 1))
        one = left >= zero
        left = left - np.where(one, zero, 0)
        slot = (slot << 1) | one
        mirrored |= one.astype(np.int64) << i
    return slot


def slot_of(rank: Column, first: Column, slots: Column, bits: int) -> Column:
    @F.pandas_udf("bigint")
    def run(r: pd.Series, f: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(nth_slot(r.to_numpy(np.int64), f.to_numpy(np.int64), n.to_numpy(np.int64), bits))

    return run(rank, first, slots)


def plan(targets: DataFrame, sizes: DataFrame, total: float | None = None) -> tuple[DataFrame, int, float]:
    """``PLAN``, one row for each source with a target; the bits of a slot, and the tokens of one.

    ``targets``: ``source, share, cap``; ``sizes``: ``source, tokens, documents``, one row per source. Null, negative and NaN
    shares count as 0, a null cap as 1; a source named twice adds up its shares and has the smaller cap. ``first`` and
    ``slots`` are the source's points; a source that can't be filled has none.
    """
    share = F.when((F.col("share") > 0) & ~F.isnan("share"), F.col("share")).otherwise(0.0)
    t = targets.filter("source is not null").groupBy("source").agg(F.sum(share).alias("target_share"), F.greatest(F.lit(0), F.min(F.coalesce("cap", F.lit(1)))).cast("int").alias("max_repeats"))
    t = t.join(sizes, "source", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("tokens", "documents")})
    weight = F.when((F.col("tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    t = materialize(t.withColumn("weight", weight), "targets")
    full = t.agg(F.sum("weight")).first()[0] or 0.0
    reach = F.lit(0.0) if not full else F.col("weight") / F.lit(full)
    t = t.withColumn("reach", reach)
    most = t.filter("reach > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("reach"))).first()[0] or 0.0
    size = most if total is None else float(total) if most else 0.0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1.0, size / SLOT_TOKENS)))))
    # running sums over one row per source; equal to the next one's begin, so that each point has one source
    order = Window.partitionBy().orderBy("reach", "source")
    upto = F.when(F.row_number().over(Window.partitionBy().orderBy(F.desc("reach"), F.desc("source"))) == 1, 1.0).otherwise(F.least(F.lit(1.0), F.sum("reach").over(order)))
    t = t.withColumn("end", F.ceil(upto * F.lit(float(1 << bits))).cast("bigint"))
    t = t.withColumn("first", F.coalesce(F.lag("end").over(order), F.lit(0).cast("bigint")))
    slots = F.when(F.col("reach") > 0, F.col("end") - F.col("first")).otherwise(F.lit(0)).cast("bigint")
    t = t.select("source", "target_share", "max_repeats", F.col("tokens").alias("source_tokens"), "documents", F.col("reach").alias("reachable_share"), "first", slots.alias("slots"))
    return materialize(t, "plan"), bits, size / (1 << bits)


def schedule(plan: DataFrame, bits: int) -> DataFrame:
    """``slot, source, rank``: the whole schedule as a table, for looking at. The mix doesn't need it."""
    d = plan.filter("slots > 0").select("source", "first", "slots", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("rank"))
    return d.select(slot_of(F.col("rank"), F.col("first"), F.col("slots"), bits).alias("slot"), "source", "rank")


def laid_out(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (written: ``id, source, n_tokens``) with ``begin``: the tokens of the source before the document, in the
    order of a hash of its id."""
    h = F.xxhash64(F.lit(seed), F.col("id"))
    d = docs.withColumn("h", h).withColumn("part", F.shiftrightunsigned("h", 64 - PART_BITS).cast("int"))
    parts = d.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("source", "part", F.coalesce(before, F.lit(0).cast("bigint")).alias("before"))
    within = Window.partitionBy("source", "part").orderBy("h", "id", "n_tokens", "copy").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("copy", F.monotonically_increasing_id())
    d = d.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0).cast("bigint")))
    return d.join(parts, ["source", "part"]).select("id", "source", "n_tokens", "h", (F.col("before") + F.col("inside")).alias("begin"))


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 1, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (``slot, id, source, use, n_tokens``; ``use`` counts from 1) and the plan it follows.

    ``docs``: ``id, source, n_tokens``, a written table; ``targets``: ``source, share, cap``; ``total``: the tokens wanted, or null
    for the most at which every source holds its share. Documents without source, without target and without tokens
    (null, 0 or fewer) aren't used. Rows with equal ids are documents of their own, a null id is one too. A document longer
    than a block stays whole and takes the place of the slots it covers. Without documents or targets the mix is empty.
    Other columns aren't read.
    """
    used = docs.select("id", "source", "n_tokens").filter("source is not null and n_tokens > 0")
    p, bits, block = plan(targets, used.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), total)
    mine = materialize(p.filter("slots > 0").select(F.col("source").alias("of"), "max_repeats", "source_tokens", "documents", "first", "slots"), "filled")
    d = bounded_join(laid_out(used, seed), mine, ["source"], ["of"], "documents")
    # a document is used in round u if its block, counted on through the rounds, has a slot
    rounds = F.least(F.col("max_repeats").cast("bigint"), F.ceil((F.col("slots") * F.lit(block) - F.col("begin")) / F.col("source_tokens")).cast("bigint"))
    d = d.filter(rounds > 0).withColumn("use", F.explode(F.sequence(F.lit(1).cast("bigint"), rounds)))
    d = d.withColumn("rank", F.floor((F.col("begin") + (F.col("use") - 1) * F.col("source_tokens")) / F.lit(block)).cast("bigint")).filter("rank < slots")
    return d.select(slot_of(F.col("rank"), F.col("first"), F.col("slots"), bits).alias("slot"), "id", "source", "use", "n_tokens"), p


def shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source with a target: its share, the one that can be reached, the one reached, tokens, documents and uses, and
    whether its documents were spent before its slots."""
    per = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("use").alias("most_uses"))
    d = plan.select("source", "target_share", "reachable_share", "source_tokens", "documents", "max_repeats").join(per, "source", "left").fillna(0, ["tokens", "uses", "most_uses"])
    all_ = F.sum("tokens").over(Window.partitionBy())  # one row per source
    d = d.withColumn("spent", (F.col("reachable_share") > 0) & (F.col("uses") == F.col("documents") * F.col("max_repeats")))
    return d.drop("documents").withColumn("actual_share", F.try_divide("tokens", all_))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    t = spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    targets = t.select("source", F.col("target_share").alias("share"), F.col("max_repeats").alias("cap"))
    names = targets.select("source").distinct()
    few = names.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    named = d.join(F.broadcast(names) if few else names, "source", "left_semi")
    ids = named.select(F.struct("doc_id", "source").alias("k"), "text")
    counted = encoded(ids, "k", "text", read_ranks(), counts_only=True)
    docs = materialize(counted.select(F.col("k.doc_id").alias("id"), F.col("k.source").alias("source"), "n_tokens"), "tokens")
    return mixed(docs, targets)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, _ = _mix(spark, sf_dir)
    return mix.withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(*_mix(spark, sf_dir))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
