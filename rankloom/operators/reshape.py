"""Between the nested form (a row per problem, candidates in an array) and the flat form (a row per candidate)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def unnest(df: DataFrame, array: str, carry: Sequence[str], outer: bool = False) -> DataFrame:
    """One row per element of an array of structs, with the carried columns; ``outer`` keeps rows of empty arrays."""
    return df.select(*carry, (F.inline_outer if outer else F.inline)(array))


def renest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], array: str, order: str) -> DataFrame:
    """The inverse: per key the rows as an array of structs, ordered by ``order`` (which may be one of the fields)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*fields).alias("__v"))))
    return df.groupBy(*keys).agg(F.transform(items, lambda x: x["__v"]).alias(array))


def with_positions(array: Column, name: str = "sid") -> Column:
    """The structs of an array with their position from 0."""
    return F.transform(array, lambda x, i: x.withField(name, i))


def partition_array(array: Column, keep) -> tuple[Column, Column]:
    """(elements for which ``keep`` holds, the others)."""
    return F.filter(array, keep), F.filter(array, lambda x: ~F.coalesce(keep(x), F.lit(False)))


def zipped(df: DataFrame, arrays: dict[str, str], carry: Sequence[str], unequal: str = "error") -> DataFrame:
    """Parallel arrays as rows with ``pos``: ``arrays`` maps the column of each array to the name of its elements.

    Arrays of one row must be equally long; otherwise the query fails, or with ``unequal="null"`` the shorter ones end in nulls. A
    row in which all arrays are null or empty gives no rows.
    """
    names = list(arrays)
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.size(n) == F.size(names[0]))
    if unequal == "null":
        pairs = F.arrays_zip(*[F.coalesce(F.col(n), F.array().cast(df.schema[n].dataType)).alias(n) for n in names])
    else:
        pairs = F.arrays_zip(*names)
    checked = pairs if unequal == "null" else F.when(same, pairs).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    return df.select(*carry, F.posexplode(checked).alias("pos", "z")).select(*carry, "pos", *[F.col(f"z.{n}").alias(a) for n, a in arrays.items()])


def paired_choices(df: DataFrame) -> DataFrame:
    """Each candidate twice: with the failing (target 0) and the passing (target 1) choice."""
    return df.withColumn("target", F.explode(F.array(F.lit(0), F.lit(1))))


def repaired(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The inverse: ``failed_score`` and ``score`` of each candidate."""
    return df.groupBy(*keys).agg(F.max(F.when(F.col("target") == 0, F.col(value))).alias("failed_score"), F.max(F.when(F.col("target") == 1, F.col(value))).alias("score"))


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns named by their path."""

    def walk(schema: StructType, path: str, label: str) -> list[Column]:
        out = []
        for f in schema.fields:
            p, name = f"{path}`{f.name}`", f"{label}{f.name}"
            out += walk(f.dataType, f"{p}.", f"{name}{sep}") if isinstance(f.dataType, StructType) else [F.col(p).alias(name)]
        return out

    return df.select(*walk(df.schema, "", ""))


def concatenated(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all parts, by column name; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_members(have: Column, expected: Column) -> Column:
    """What is expected and not there."""
    return F.array_except(expected, have)
