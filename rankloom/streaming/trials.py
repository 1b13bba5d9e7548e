"""Trials as a stream (an extension: the batch surface has no streams). Trial files arrive in a folder; flags and counts are
kept up to date, with late and repeated rows accounted for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.schemas import schema


def trial_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of trial rows, as they arrive."""
    s = schema("trial_row").add("finished_at", "timestamp")
    return spark.readStream.schema(s).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def windowed_pass_rates(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window of the end of execution: trials, passed ones, and their share; rows delivered again count once."""
    d = stream.withWatermark("finished_at", late).dropDuplicates(["trial", "task_id", "sid", "finished_at"])
    g = d.groupBy(F.window("finished_at", window).alias("w")).agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.coalesce(F.col("passed"), F.lit(False))).alias("passed"))
    return g.select(F.col("w.start").alias("start"), "trials", "passed", F.try_divide("passed", "trials").alias("share"))


def keep_flags(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("task_id", "sid"), trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch's ``keys, passed, timeout`` (any trial) as Parquet below ``path``, one folder per batch: a batch that
    is run again overwrites its own folder. ``current_flags`` reads all of them as one table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.bool_or("passed").alias("passed"), F.bool_or("timeout").alias("timeout")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_flags(spark: SparkSession, path: str, keys: Sequence[str] = ("task_id", "sid")) -> DataFrame:
    """The flags over all batches so far."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.bool_or("passed").alias("passed"), F.bool_or("timeout").alias("timeout"))
