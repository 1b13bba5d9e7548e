"""Joins and aggregates that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys treated as hot; the hot part of the small side is broadcast, so this bounds it.
MAX_HOT = 1000


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of all pairs of columns, nulls equal to nulls."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def hot_split_join(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner equi-join of many rows with a table that has ``key`` once, where few keys may hold most of ``left``.

    ``weight`` is the column of ``right`` with the rows that each key has in ``left``. The ``MAX_HOT`` heaviest keys
    are broadcast, so their rows are joined where they lie; all other keys go through a shuffle. Nothing is dropped.
    Null keys match nothing. Both inputs are read twice, so give written tables.
    """
    hot = right.orderBy(F.desc(weight), F.col(key)).limit(MAX_HOT)
    flag = hot.select(F.col(key), F.lit(True).alias("__hot"))
    by_broadcast = left.join(F.broadcast(hot), key)
    rest_left = left.join(F.broadcast(flag), key, "left_anti")
    rest_right = right.join(F.broadcast(flag), key, "left_anti")
    return by_broadcast.unionByName(rest_left.join(rest_right, key))


#: Rows of a small side that may be broadcast: with keys of some tens of bytes about 5 MB.
MAX_BROADCAST = 50_000


def bounded_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], weight: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """Equi-join, nulls equal to nulls, of many rows with a written table that has each key once; ``how`` is inner or left.

    ``weight`` is the column of ``right`` with (about) the rows that each key has in ``left``. A table of up to ``most`` rows is
    broadcast. Of a longer one only the keys that hold more than ``1 / most`` of all weight are, which can't be more than
    ``most``: their rows are joined where they lie, and the others, none of them heavy, go through a shuffle. Column names
    of the two sides must differ. Nothing is dropped; ``left`` is read twice in the second case.
    """
    most = MAX_BROADCAST if most is None else most
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left_on, right_on)]
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on, how)
    total = right.agg(F.sum(weight).cast("double")).first()[0] or 0.0
    heavy = right.filter(F.col(weight) * F.lit(float(most)) > total)
    light = right.filter(~F.coalesce(F.col(weight) * F.lit(float(most)) > total, F.lit(False)))
    here = left.join(F.broadcast(heavy), on, "inner")
    rest = left.join(F.broadcast(heavy.select(*right_on)), on, "left_anti")
    return here.unionByName(rest.join(light, on, how), allowMissingColumns=True)
