"""Scores from logits, and the slot for an opaque model.

A model is any callable over Arrow batches; everything around it is arithmetic on arrays and stays in the plan.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rankloom.functions import arrays as A
from rankloom.operators.batching import packed


class Scorer(Protocol):
    """What a scorer gives: expressions for a row's score, its counterpart for failing, and the predicted outcome."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def binary(df: DataFrame, passing: Column, failing: Column, mask: Column | None = None, extra_token: bool = False) -> DataFrame:
    """Mean logits of the passing and the failing choice as ``score, failed_score, pred``.

    ``passing`` and ``failing`` are arrays over the choice's tokens; ``extra_token`` divides by one token more, as the
    published log-probability scores do.
    """

    def mean(x: Column) -> Column:
        m = mask if mask is not None else A.attention(x)
        v = A.masked_mean(x, m)
        n = F.aggregate(m, F.lit(0.0), lambda a, y: a + F.when(y != 0, 1.0).otherwise(0.0))
        return v * n / (n + 1) if extra_token else v

    d = df.withColumn("score", mean(passing)).withColumn("failed_score", mean(failing))
    return d.withColumn("pred", F.col("score") > F.col("failed_score"))


def single_token(df: DataFrame, logits: Column, pass_id: int, fail_id: int, as_logprob: bool = False) -> DataFrame:
    """The last token's logits of two vocabulary entries; the log-probability form gives the logits too, as published."""
    d = df.withColumn("score", F.element_at(logits, pass_id + 1)).withColumn("failed_score", F.element_at(logits, fail_id + 1))
    return d.withColumn("pred", F.col("score") > F.col("failed_score"))


def classification(df: DataFrame, logits: Column) -> DataFrame:
    """Two-way logits: index 0 fails, index 1 passes."""
    return single_token(df, logits, 1, 0)


def reward(df: DataFrame, value: Column) -> DataFrame:
    """One number per row; it predicts a pass when positive."""
    return df.withColumn("score", value).withColumn("failed_score", -value).withColumn("pred", value > 0)


def mean_logprob(df: DataFrame, logprobs: Column, mask: Column) -> DataFrame:
    """The mean log-probability of the tokens that aren't masked."""
    return df.withColumn("score", A.masked_mean(logprobs, mask))


def losses(df: DataFrame, score: Column, failed: Column, passed: Column) -> DataFrame:
    """``point_loss``: cross entropy of the outcome; ``pair_loss``: its loss minus the other outcome's."""
    m = F.greatest(score, failed)
    lse = m + F.log(F.exp(score - m) + F.exp(failed - m))
    lp, lf = lse - score, lse - failed
    return df.withColumn("point_loss", F.when(passed, lp).otherwise(lf)).withColumn("pair_loss", F.when(passed, lp - lf).otherwise(lf - lp))


def pair_loss(chosen: Column, rejected: Column, margin: Column | None = None, center: float = 0.0) -> Column:
    """``-log sigmoid(chosen - rejected - margin)``, with an optional pull of both towards 0."""
    x = chosen - rejected - (margin if margin is not None else F.lit(0.0))
    loss = F.when(x > 0, F.log1p(F.exp(-x))).otherwise(-x + F.log1p(F.exp(x)))
    return loss + F.lit(center) * F.pow(chosen + rejected, F.lit(2.0)) if center else loss


#: Scorers by name.
SCORERS: dict[str, Callable] = {
    "binary_logit": binary,
    "binary_logprob": lambda df, p, f, mask=None: binary(df, p, f, mask, extra_token=True),
    "st_binary_logit": single_token,
    "st_binary_logprob": lambda df, logits, p, f: single_token(df, logits, p, f, as_logprob=True),
    "classification": classification,
    "reward_model": reward,
    "logprob": mean_logprob,
}


def scorer(name: str) -> Callable:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def score_in_batches(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], outputs: str, length: str, key: str, budget: int, multiple: int = 8, partitions: int | None = None, setup: Callable | None = None) -> DataFrame:
    """``df`` with ``part``, ``batch``, the model's ``outputs`` (DDL) and ``score_time``, the seconds of the row's batch.

    Rows are packed by length into batches of at most ``budget`` padded tokens (``operators.batching``), and the model is called
    once for each, in the order of falling lengths; ``setup`` makes the model in each worker. Each row has its whole batch's
    time, as published. A model must give one row for each row it gets; rows without a length count as of length 0.
    """
    d = packed(df.withColumn(length, F.coalesce(F.col(length).cast("bigint"), F.lit(0).cast("bigint"))), length, key, budget, multiple, partitions)
    more = StructType.fromDDL(outputs)
    schema = StructType([*d.schema.fields, *more.fields, StructField("score_time", DoubleType())])

    def scored(rows: pd.DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame]) -> pd.DataFrame:
        began = time.perf_counter()
        got = run(rows)
        took = time.perf_counter() - began
        if len(got) != len(rows):
            raise ValueError(f"the model gave {len(got)} rows for {len(rows)}")
        return rows.assign(**{n: got[n].to_numpy() for n in more.names}, score_time=took)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, held = setup() if setup else model, None  # the last batch of an Arrow batch may go on in the next
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = b["batch"].iloc[-1] if len(b) else None
            held = b[b["batch"] == last]
            for _, rows in b[b["batch"] != last].groupby("batch", sort=True):
                yield scored(rows, run)
        if held is not None and len(held):
            yield scored(held, run)

    return d.mapInPandas(work, schema)


def score_with_model(df: DataFrame, model: Callable[[pd.DataFrame], pd.Series], score: str = "score", setup: Callable | None = None) -> DataFrame:
    """``df`` with ``score`` from an opaque model, called once per Arrow batch; ``setup`` makes the model in each worker."""
    schema = StructType([*[f for f in df.schema.fields if f.name != score], StructField(score, DoubleType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = setup() if setup else model
        for b in batches:
            yield b.drop(columns=score, errors="ignore").assign(**{score: run(b)})

    return df.mapInPandas(work, schema)
