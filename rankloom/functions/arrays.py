"""Functions over token and logit arrays, as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label of tokens that take no part in a loss.
IGNORED = -100


def with_specials(ids: Column, bos: int | None = None, eos: int | None = None) -> Column:
    """The ids with begin and end tokens, unless they are there already."""
    out = ids
    if bos is not None:
        out = F.when(F.try_element_at(ids, F.lit(1)).eqNullSafe(F.lit(bos)), ids).otherwise(F.concat(F.array(F.lit(bos)), ids))
    if eos is not None:
        out = F.when(F.try_element_at(out, F.lit(-1)).eqNullSafe(F.lit(eos)), out).otherwise(F.concat(out, F.array(F.lit(eos))))
    return out


def keep_last(ids: Column, n: int) -> Column:
    """The last ``n`` elements; all of a shorter array."""
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))


def keep_first(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def labels(prompt: Column, completion: Column) -> Column:
    """Labels of prompt and completion tokens: the prompt's are ignored."""
    return F.concat(F.transform(prompt, lambda _: F.lit(IGNORED)), completion)


def attention(ids: Column) -> Column:
    return F.transform(ids, lambda _: F.lit(1))


def padded(ids: Column, length: Column, pad: int, left: bool = False) -> Column:
    """Filled up to ``length`` with ``pad``; longer arrays stay."""
    fill = F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def pad_batches(df: DataFrame, batch: str, pads: dict[str, int], left: bool = False) -> DataFrame:
    """Each array column filled up to the longest of its batch, with its own pad value."""
    longest = df.groupBy(batch).agg(*[F.max(F.size(c)).alias(f"__{c}") for c in pads])
    d = df.join(longest, batch)
    for c, pad in pads.items():
        d = d.withColumn(c, padded(F.col(c), F.col(f"__{c}"), pad, left)).drop(f"__{c}")
    return d


def log_sum_exp(x: Column) -> Column:
    m = F.array_max(x)
    return m + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - m)))


def log_softmax_at(x: Column, index: Column) -> Column:
    """The log-probability of the element at ``index`` (from 0)."""
    return F.element_at(x, index + 1) - log_sum_exp(x)


def masked_mean(values: Column, mask: Column) -> Column:
    """The mean of the values whose mask isn't 0; null if there is none."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m != 0, v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(total, F.aggregate(mask, F.lit(0.0), lambda a, m: a + F.when(m != 0, 1.0).otherwise(0.0)))


def argmax(x: Column) -> Column:
    """The position (from 0) of the first largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
