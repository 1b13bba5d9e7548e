"""Writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.reshape import concatenated


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def partitioned(df: DataFrame, path: str, by: Sequence[str] = ("model", "setup", "dataset"), mode: str = "error") -> None:
    """One folder per value of the columns; rows are brought together first, so that a folder has few files. The exchange is one
    that adaptive execution may split, so that a cell with most rows is written by as many tasks as it needs."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def sharded(df: DataFrame, path: str, rows: int = 1000, mode: str = "error") -> None:
    """Files of at most ``rows`` rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).option("compression", "gzip").json(path)


def trial(df: DataFrame, folder: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/trial_{number}.parquet")


def csv(df: DataFrame, path: str, compressed: bool = True, mode: str = "error") -> None:
    df.write.mode(mode).option("header", "true").option("compression", "gzip" if compressed else "none").csv(path)


def text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small document on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def metrics_json(spark: SparkSession, long: DataFrame, path: str, task: str = "task", metric: str = "metric", value: str = "value", most: int = 100_000) -> dict:
    """A report's metrics as one JSON object, ``task/metric`` to value, sorted by key. Reports are small; more than ``most``
    entries are an error."""
    rows = long.select(task, metric, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many metrics for one document")
    out = {f"{r[0]}/{r[1]}": r[2] for r in sorted(rows, key=lambda r: (r[0], r[1]))}
    text_file(spark, path, json.dumps(out, indent=2))
    return out


def problem_scores(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Per problem its candidates as an array by falling score, with sum, mean, median and deviation of the elapsed times."""
    fields = [c for c in df.columns if c != "task_id"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("sid").alias("s"), F.struct(*fields).alias("v")))), lambda x: x["v"])
    t = F.col("score_time")
    out = df.groupBy("task_id").agg(listed.alias("solutions"), F.sum(t).alias("time_sum"), F.avg(t).alias("time_mean"), F.median(t).alias("time_median"), F.stddev_pop(t).alias("time_std"))
    jsonl(out, path, mode)
    return out


def splits(parts: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Datasets as the splits of one saved dataset."""
    out = concatenated([d.withColumn("split", F.lit(name)) for name, d in parts.items()])
    out.write.mode(mode).partitionBy("split").parquet(path)
