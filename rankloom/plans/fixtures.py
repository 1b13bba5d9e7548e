"""The driver's tables as domain views, and the same views in SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates, each once: deliveries of a row differ in ``ingested_at`` only.

    Grouping by the key, not by all columns, leaves the others to column pruning: what a query doesn't use isn't read. All columns
    come from the delivery that arrived last.
    """
    d = table(spark, sf_dir, "scored_solutions").filter("task_id is not null and sid is not null")
    return d.groupBy("task_id", "sid").agg(*[F.max_by(c, "ingested_at").alias(c) for c in d.columns if c not in ("task_id", "sid", "ingested_at")])


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial rows, each once."""
    d = table(spark, sf_dir, "exec_results").drop("ingested_at")
    # maps can't be compared: the redelivered rows are found by the columns that identify a trial row
    return d.dropDuplicates(["trial", "task_id", "sid", "finished_at"])


#: Common table expressions that the SQL twins begin with.
SCORED = "scored as (select distinct * exclude (ingested_at) from scored_solutions where task_id is not null and sid is not null)"
RANKED = (
    SCORED
    + """, e as (select *, case when score is null or isnan(score) then '-infinity'::double else score end eff,
  greatest(coalesce(count, 1), 1)::bigint w from scored),
ranked as (select *, sum(w) over (partition by task_id order by eff desc, sid rows unbounded preceding)::bigint hi from e),
iv as (select *, hi - w lo from ranked),
x as (select task_id, passed, passed_public, passed_plus, i, num_tests_passed g, eff from (select *, unnest(range(lo, hi)) i from iv)),
tot as (select task_id, count(*) n, count(*) filter (passed) r from x group by 1)"""
)
TRIALS = "trials as (select distinct on (trial, task_id, sid, finished_at) * exclude (ingested_at) from exec_results)"
