"""Joins of candidates with dimensions. All are equi-joins N:1; small sides are left to adaptive execution, which broadcasts
a side only after it has measured it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.skew import bounded_join
from rankloom.session import materialize


def with_problem_text(rows: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their problem; rows without one are left out."""
    return rows.join(problems, key)


def with_hot_text(rows: DataFrame, problems: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """The same where few problems have most of the rows: their rows are joined where they lie (``skew.bounded_join``). ``problems``
    has each key once; rows with a null key are left out."""
    weight = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    p = materialize(problems.join(weight, key).withColumnRenamed(key, "__key"), "weighed")
    return bounded_join(rows.filter(F.col(key).isNotNull()), p, [key], ["__key"], "__rows", most=most).drop("__key", "__rows")


def validated_join(rows: DataFrame, meta: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Rows with their metadata by ``key``; a column of ``same`` that both have must agree, else the query fails."""
    m = meta.select(key, *[F.col(c).alias(f"__m_{c}") for c in meta.columns if c != key])
    d = rows.join(m, key)
    for c in same:
        d = d.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__m_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"metadata disagrees in {c}"))))
    return d.select(*rows.columns, *[F.col(f"__m_{c}").alias(c) for c in meta.columns if c != key and c not in rows.columns])


def checked_join(results: DataFrame, predictions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Results with their predictions; a result without one makes the query fail."""
    p = predictions.withColumn("__there", F.lit(True))
    d = results.join(p, list(on), "left")
    return d.withColumn("__there", F.when(F.col("__there"), True).otherwise(F.raise_error(F.lit("result without prediction")))).filter("__there").drop("__there")


def in_set(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def not_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``keys``; rows with a null key stay."""
    return df.join(keys.select(key), key, "left_anti")


#: Most cells of a grid of settings.
MOST_CELLS = 1_000_000


def config_grid(measured: DataFrame, dims: Sequence[str]) -> DataFrame:
    """All cells of the grid of the dimensions' values, with ``exists``: whether ``measured`` has rows of the cell. Rows with a null
    in a dimension are of no cell. The dimensions are settings; a grid of more than MOST_CELLS is an error."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in dims])
    measured = measured.filter(known)
    sizes = measured.agg(*[F.count_distinct(c).alias(c) for c in dims]).first()
    if math.prod(sizes) > MOST_CELLS:
        raise ValueError(f"a grid of {math.prod(sizes)} cells")
    values = measured.agg(*[F.collect_set(c).alias(c) for c in dims])
    for c in dims:
        values = values.withColumn(c, F.explode(c))
    there = measured.select(*dims).distinct().withColumn("exists", F.lit(True))
    return values.join(there, list(dims), "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def missing_cells(measured: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The cells of the grid that don't exist."""
    return config_grid(measured, dims).filter("not exists").drop("exists")


def stage_times(timings: DataFrame, key: Sequence[str], time: str = "time") -> DataFrame:
    """The mean time of every cell of the grid of ``key``, by lookup: null where it was never measured."""
    per = timings.groupBy(*key).agg(F.avg(time).alias(time))
    return config_grid(timings, key).drop("exists").join(per, list(key), "left")


def serialized(samples: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """Samples as one row for each prompt: ``predictions``, an array of records in the order of generation, and ``row_id``."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*fields).alias("__v"))))
    out = samples.groupBy(*keys).agg(F.transform(listed, lambda x: x["__v"]).alias("predictions"))
    return out.withColumn("row_id", F.pmod(F.xxhash64(*keys), F.lit(1 << 31)).cast("int"))


def repeated_prompts(prompts: DataFrame, times: int) -> DataFrame:
    """Each prompt ``times`` times with ``rep``."""
    return prompts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def merged_repeats(rows: DataFrame, keys: Sequence[str], value: str, expected: Column | None = None) -> DataFrame:
    """The repeats of a prompt merged again: the arrays of ``value`` appended in the order of ``rep``; the total must be as
    expected, if that is given."""
    lists = F.array_sort(F.collect_list(F.struct("rep", value)))
    out = rows.groupBy(*keys).agg(F.flatten(F.transform(lists, lambda x: x[value])).alias(value))
    if expected is not None:
        out = out.withColumn(value, F.when(F.size(value) == expected, F.col(value)).otherwise(F.raise_error(F.lit("unexpected number of samples"))))
    return out
