"""Session helpers: a tuned local session, table access, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit both a laptop and a cluster; the size-dependent ones stay with the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "rankloom") -> SparkSession:
    """A local session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        path = os.path.join(tempfile.gettempdir(), f"rankloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, on whatever file system it lies."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    The files lie in the shared folder, so a lost executor costs nothing that was written. They are deleted with
    the session (``release`` deletes them earlier).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop_path, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rankloom_path = path
    if _open_steps:
        _open_steps[-1].append(out)
    return out


_open_steps: list[list[DataFrame]] = []


class Steps:
    """The tables written within a ``with`` block, to be deleted together once what is made from them is written itself."""

    def __enter__(self) -> Steps:
        self.tables: list[DataFrame] = []
        _open_steps.append(self.tables)
        return self

    def __exit__(self, *_: object) -> None:
        _open_steps.remove(self.tables)

    def release(self, *keep: DataFrame) -> None:
        for d in self.tables:
            if not any(d is k for k in keep):
                release(d)


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_rankloom_path", None)
    if path:
        drop_path(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores, spread over them, for work that costs more than the move."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
