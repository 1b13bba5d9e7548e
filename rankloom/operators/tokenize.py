"""Texts as token ids, and the arrays that training and scoring need around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import arrays as A

#: A pair with a side longer than this is left out.
LONGEST_SIDE = 32_000

Encode = Callable[[list[str]], list[list[int]]]


def byte_encoder(texts: list[str]) -> list[list[int]]:
    """The bytes of the texts as ids: needs no vocabulary."""
    return [list(t.encode()) for t in texts]


def library_encoder(path: str) -> Callable[[], Encode]:
    """An encoder from a tokenizer file of the ``tokenizers`` library, loaded once per worker."""

    def make() -> Encode:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]

    return make


def token_ids(df: DataFrame, text: str, ids: str, setup: Callable[[], Encode] = lambda: byte_encoder) -> DataFrame:
    """``df`` with the ids of a text column; a null text has null ids."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = setup()
        for s in batches:
            known = s[s.notna()]
            got = dict(zip(known.index, encode(known.tolist())))
            yield pd.Series([got.get(i) for i in s.index], dtype=object)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(ids, F.pandas_udf(work, "array<int>")(F.col(text)))


def byte_decoder(ids: list[list[int]]) -> list[str]:
    """The text of whole characters among the bytes."""
    return [bytes(x).decode("utf-8", "ignore") for x in ids]


def truncated_text(text: Column, n: int, encode: Encode = byte_encoder, decode: Callable[[list[list[int]]], list[str]] = byte_decoder) -> Column:
    """The text of the first ``n`` tokens; a text of no more stays as it is, a null one null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = s[s.notna()].tolist()
        ids = encode(known)
        short = iter(decode([x[:n] for x in ids]))
        cut = iter([t if len(x) <= n else c for t, x, c in zip(known, ids, short)])
        return pd.Series([None if v is None else next(cut) for v in s.where(s.notna(), None)], dtype=object)

    return run(text)


def causal_rows(df: DataFrame, prompt: str, completion: str, bos: int | None, eos: int | None, longest: int) -> DataFrame:
    """``input_ids, labels, attention_mask`` from the ids of prompt and completion, cut on the left to ``longest``."""
    p = A.with_specials(F.col(prompt), bos=bos)
    c = A.with_specials(F.col(completion), eos=eos)
    d = df.withColumn("input_ids", A.keep_last(F.concat(p, c), longest)).withColumn("labels", A.keep_last(A.labels(p, c), longest))
    return d.withColumn("attention_mask", A.attention(F.col("input_ids")))


def classification_rows(df: DataFrame, ids: str, passed: str, eos: int | None, longest: int) -> DataFrame:
    """``input_ids, attention_mask, labels``: the whole text, and the outcome as 0 or 1."""
    d = df.withColumn("input_ids", A.keep_last(A.with_specials(F.col(ids), eos=eos), longest))
    return d.withColumn("attention_mask", A.attention(F.col("input_ids"))).withColumn("labels", F.coalesce(F.col(passed), F.lit(False)).cast("int"))


def pair_rows(df: DataFrame, chosen: str, rejected: str, longest: int = LONGEST_SIDE) -> DataFrame:
    """Pairs neither side of which is longer than ``longest``."""
    return df.filter((F.size(chosen) <= longest) & (F.size(rejected) <= longest))


def choice_mask(query: Column, completion: Column) -> Column:
    """1 for the completion's tokens, 0 for the query's."""
    return F.concat(F.transform(query, lambda _: F.lit(0)), F.transform(completion, lambda _: F.lit(1)))
