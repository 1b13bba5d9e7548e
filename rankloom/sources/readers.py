"""Readers. Each declares its schema; gzip is transparent to Spark but not splittable, so many files, not large ones, spread."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import file_shard, file_task, renamed_setup
from rankloom.sources.schemas import schema


def jsonl(spark: SparkSession, path: str | Sequence[str], record: str, partitions: int | None = None, strict: bool = True) -> DataFrame:
    """JSON lines, plain or gzipped. A line that doesn't fit the schema fails, or is all null if not ``strict``.

    ``partitions`` spreads the rows of few large gzip files.
    """
    d = spark.read.schema(schema(record)).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path if isinstance(path, str) else list(path))
    return d.repartition(partitions) if partitions else d


def subset_name(model: str, setup: str, task: str) -> str:
    """The name of a hosted subset."""
    return f"{model}_{renamed_setup(setup)}_{task}".replace("/", "_")


def subset(spark: SparkSession, root: str, model: str, setup: str, task: str) -> DataFrame:
    """A hosted subset, as a folder of Parquet below ``root``."""
    return spark.read.parquet(f"{root}/{subset_name(model, setup, task)}")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Raw prediction files of any number of tasks, with ``task`` from the file's name."""
    return jsonl(spark, path, "raw_prediction").withColumn("task", file_task(F.col("_metadata.file_path")))


def tree(spark: SparkSession, root: str, record: str, pattern: str = "*.jsonl.gz") -> DataFrame:
    """Files in folders ``root/model/setup/file``, plain or named as partitions are, with ``tree_model, tree_setup, task`` from
    their paths."""
    d = spark.read.schema(schema(record)).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder = lambda i: F.regexp_replace(F.element_at(parts, i), "^[^=]*=", "")
    return d.select("*", folder(-3).alias("tree_model"), folder(-2).alias("tree_setup"), file_task(F.col("_metadata.file_path")).alias("task"))


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards of generated predictions, plain or gzipped, with the shard's number."""
    return jsonl(spark, path, "shard_prediction").withColumn("shard", file_shard(F.col("_metadata.file_path")))


def trial_results(spark: SparkSession, folder: str) -> DataFrame:
    """The trial files of a run (``trial_*.parquet``); its result table ``results.parquet`` is left out."""
    return spark.read.parquet(f"{folder}/trial*.parquet")


def flags(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Filter flags from CSV files, plain or gzipped, as one table."""
    return spark.read.schema(schema("filter_flags")).csv(path if isinstance(path, str) else list(path), header=True)


def filter_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema("filter_timing")).csv(path, header=True)


def document(spark: SparkSession, path: str, record: str | None = None) -> DataFrame | dict:
    """A JSON document: as rows of a record, or, for a setting, as a dictionary."""
    if record:
        return spark.read.schema(schema(record)).json(path, multiLine=True)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def split(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One split of a saved dataset: Parquet partitioned by ``split``."""
    return spark.read.parquet(root).filter(F.col("split") == name)


def execution_problems(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, "execution_problem")


#: Benchmarks by name: how their rows become ``task_id, query, tests`` with what else the benchmark has. ``query`` is what is
#: asked: with the assertions where the benchmark shows them.
_BENCHMARKS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def _none() -> Column:
    return F.array().cast("array<string>").alias("tests")


def benchmark(name: str) -> Callable:
    """Register a benchmark's projection."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        _BENCHMARKS[name] = f
        return f

    return add


@benchmark("code_contests")
def _contests(d: DataFrame) -> DataFrame:
    return d.select(F.concat_ws("/", F.lit("code_contests"), F.col("idx")).alias("task_id"), F.col("description").alias("query"), _none(), *[c for c in d.columns if c not in ("description", "idx")])


@benchmark("gsm8k")
def _gsm8k(d: DataFrame) -> DataFrame:
    return d.select(F.concat_ws("/", F.lit("gsm8k"), F.col("idx")).alias("task_id"), F.col("question").alias("query"), _none(), "answer")


@benchmark("mbpp")
def _mbpp(d: DataFrame) -> DataFrame:
    return d.select("task_id", F.concat_ws("\n", "prompt", "test_list").alias("query"), F.col("test_list").alias("tests"), "entry_point")


@benchmark("humaneval")
def _humaneval(d: DataFrame) -> DataFrame:
    return d.select("task_id", F.col("prompt").alias("query"), F.array("test").alias("tests"), "entry_point")


def load_benchmark(df: DataFrame, name: str) -> DataFrame:
    """The rows of a benchmark in common form."""
    if name not in _BENCHMARKS:
        raise ValueError(f"unknown benchmark {name!r}; known: {', '.join(sorted(_BENCHMARKS))}")
    return _BENCHMARKS[name](df)
