"""Minwise signatures of the word runs of texts, made in numpy over Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.codepoints import U, mix, runs

#: Minwise tokens of a text. Each also gives four bits of the sketch, so 16 of them fill one integer of the sketch.
TOKENS = 48
SKETCH = TOKENS // 16
#: Texts worked on at once: their word runs stay in the processor's cache.
CHUNK = 256

SCHEMA = "id bigint, side int, h binary, n int, tokens array<int>, " + ", ".join(f"s{i} bigint" for i in range(SKETCH))


@functools.cache
def _family(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, TOKENS, dtype=U) * U(2) + U(1), rng.integers(0, 2**63, TOKENS, dtype=U)


def signatures(texts: list[str], k: int) -> tuple[np.ndarray, ...]:
    """Of the texts with at least ``k`` words: index, 128-bit hash of the set, its size, tokens, sketch."""
    doc, s = runs(texts, k)
    if not len(s):
        return np.zeros(0, int), np.zeros(0, "S16"), np.zeros(0, np.int32), np.zeros((0, TOKENS), np.int32), np.zeros((0, SKETCH), np.int64)
    first = np.flatnonzero(np.append(True, np.diff(doc) > 0))
    size = np.diff(np.append(first, len(s))).astype(np.int32)
    a, b = _family()
    low = np.empty((len(first), TOKENS), np.uint32)
    for i in range(TOKENS):
        low[:, i] = np.minimum.reduceat((s * a[i] + b[i]) >> U(32), first)
    h = np.stack([np.add.reduceat(mix(s ^ U(c)), first) for c in (0x1234567, 0x7654321ABC)], 1)
    bits = (mix(low.astype(U)) & U(15)).reshape(-1, SKETCH, 16) << (U(4) * np.arange(16, dtype=U))
    sketch = np.bitwise_or.reduce(bits, axis=2)
    return doc[first], h, size, low.view(np.int32), sketch.view(np.int64)


def signed(df: DataFrame, k: int) -> DataFrame:
    """``SCHEMA`` for the rows of ``df`` (``id bigint, side int, text string``); null and short texts give no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                texts = [t or "" for t in part.column(2).to_pylist()]
                i, h, size, tokens, sketch = signatures(texts, k)
                if not len(i):
                    continue
                ends = np.arange(0, 16 * len(i) + 1, 16, dtype=np.int32)
                cols = [
                    part.column(0).take(pa.array(i)),
                    part.column(1).take(pa.array(i)),
                    pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(h))]),
                    pa.array(size),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, TOKENS, dtype=np.int32)), pa.array(tokens.reshape(-1))),
                    *[pa.array(np.ascontiguousarray(sketch[:, x])) for x in range(SKETCH)],
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "side", "h", "n", "tokens", *[f"s{x}" for x in range(SKETCH)]])

    return df.select("id", "side", "text").mapInArrow(work, SCHEMA)


def run_sets(df: DataFrame, k: int) -> DataFrame:
    """``id, items array<int>``: the sorted set of word-run hashes of each text, in 32 bits each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                doc, s = runs([t or "" for t in part.column(1).to_pylist()], k)
                if len(doc):
                    first = np.flatnonzero(np.append(True, np.diff(doc) > 0))
                    items = (s >> U(32)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[first])), pa.ListArray.from_arrays(pa.array(np.append(first, len(s)).astype(np.int32)), pa.array(items))], ["id", "items"])

    return df.select("id", "text").mapInArrow(work, "id bigint, items array<int>")
