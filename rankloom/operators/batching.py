"""Packing rows into batches of bounded padded tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def padded_length(length, multiple: int):
    """The length filled up to the next multiple; a whole multiple more where it is one already, as published."""
    return length + multiple - length % multiple


def pack_lengths(lengths: np.ndarray, budget: int, multiple: int = 8) -> np.ndarray:
    """Batch numbers of lengths in falling order: a batch takes rows while rows times its longest padded length fit."""
    out, at, batch = np.empty(len(lengths), np.int64), 0, 0
    while at < len(lengths):
        size = max(1, budget // max(1, int(padded_length(int(lengths[at]), multiple))))
        out[at : at + size] = batch
        at, batch = at + size, batch + 1
    return out


def packed(df: DataFrame, length: str, key: str, budget: int, multiple: int = 8, partitions: int | None = None) -> DataFrame:
    """``df`` with ``part`` and ``batch``: rows sorted by falling length, packed within each part of the order.

    Rows are range partitioned by length, so that neighbours in length stay together and each part is packed by one task;
    a batch is identified by ``part`` and ``batch``. One partition packs as a single loader would.
    """
    order = [F.desc(length), F.asc(key)]
    d = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    d = d.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = StructType([*d.schema.fields, StructField("batch", LongType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, limit, current = 0, 0, -1  # rows the open batch may still take
        for b in batches:
            n, numbers, at = len(b), np.empty(len(b), np.int64), 0
            lengths = b[length].to_numpy()
            while at < n:
                if left == 0:
                    current, left = current + 1, max(1, budget // max(1, int(padded_length(int(lengths[at]), multiple))))
                take = min(left, n - at)
                numbers[at : at + take] = current
                at, left = at + take, left - take
            yield b.assign(batch=numbers)

    return d.mapInPandas(work, schema)


def estimated_batches(df: DataFrame, length: Column, budget: int) -> DataFrame:
    return df.agg(F.ceil(F.sum(length) / budget).alias("batches"))
