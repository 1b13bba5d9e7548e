"""Problem 7: encoding of whole texts by a public byte-level BPE vocabulary.

Method: a batch of texts becomes one array of code points; the splitting pattern's token borders follow from the
classes of neighbouring code points; different pieces are found by hash; the new ones lie as rows of padded matrices,
bucketed by length, in which each round every row merges its leftmost pair of minimum rank. Ranks of pairs come from a
hash table held in numpy; rows without a pair leave the matrix, and each round closes the gap of the merged column.

The splitting pattern is the one published with the vocabulary: contractions ('s 't 're 've 'm 'll 'd), letters,
numbers and other characters with one leading space each, and white space.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.codepoints import LETTER, OTHER, SPACE, U, classes, mix, points, powers

#: Where the vocabularies of public tokenizers lie, unless another path is given.
VOCABULARIES = "/opt/tokenizers"
#: Rank of a pair that no merge joins.
NONE = np.int32(2**31 - 1)
#: Pieces longer than this many bytes are merged one by one, all places of the minimum pair in one round.
LONG = 96
#: Pieces remembered by a worker; beyond, it starts afresh. Only speed depends on it.
REMEMBERED = 400_000
#: Code points worked on at once; a longer text is worked on alone, whole.
CHUNK_POINTS = 150_000


class PairTable:
    """Ranks of pairs of ids: open addressing with linear probing over a power of two of slots."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(8, int(len(pairs) * 6).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.probes, left, slot = 0, np.arange(len(pairs)), self._slot(pairs)
        while len(left):
            free = self.keys[slot] == -1
            _, winner = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            winner = winner[free[winner]]
            self.keys[slot[winner]], self.ranks[slot[winner]] = pairs[left[winner]], ranks[left[winner]]
            rest = np.ones(len(left), bool)
            rest[winner] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is none or either id is negative (padding)."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        flat = key.ravel()
        slot = self._slot(flat)
        got = self.keys[slot]
        out = np.where(got == flat, self.ranks[slot], NONE)
        open_ = np.flatnonzero((got != flat) & (got != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            got = self.keys[slot[open_]]
            hit = got == flat[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out.reshape(key.shape)


class Vocabulary:
    """The merges of a rank file (lines of base64 and rank), and the pieces met so far."""

    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, merged = [], []
        get = ranks.get
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self.rank = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        self.forget()

    def forget(self) -> None:
        self.known, self.check = np.zeros(0, U), np.zeros(0, U)
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge_rows(self, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their ids, padded with -1) of a matrix of byte ids padded with -1."""
        done, rows, r = [], np.arange(len(m)), self.rank(m[:, :-1], m[:, 1:])
        while len(rows):
            j = r.argmin(axis=1) if r.shape[1] else np.zeros(len(rows), int)
            best = r[np.arange(len(rows)), j] if r.shape[1] else np.full(len(rows), NONE)
            go = best < NONE
            if not go.all():
                done.append((rows[~go], m[~go]))
                rows, m, r, j, best = rows[go], m[go], r[go], j[go], best[go]
                if not len(rows):
                    break
            at, width = np.arange(len(rows)), m.shape[1]
            m[at, j] = best
            cols = np.arange(width - 1)
            m = np.take_along_axis(m, cols + (cols > j[:, None]), 1)
            cols = cols[:-1]
            r = np.take_along_axis(r, cols + (cols > j[:, None]), 1) if width > 2 else r[:, :0]
            if width > 2:
                left, right = j > 0, j < width - 2
                a, b = at[left], j[left]
                r[a, b - 1] = self.rank(m[a, b - 1], m[a, b])
                a, b = at[right], j[right]
                r[a, b] = self.rank(m[a, b], m[a, b + 1])
        return done

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The ids of one long piece. A merge only makes pairs of higher rank, so that all places of the minimum pair
        can be merged in one round, from the left, as one at a time would."""
        while len(ids) > 1:
            r = self.rank(ids[:-1], ids[1:])
            best = r.min()
            if best == NONE:
                break
            at = np.flatnonzero(r == best)
            start = np.ones(len(at), bool)
            start[1:] = np.diff(at) > 1
            first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of a byte array: how many each has, and all of them one after another."""
        out: list = [None] * len(begin)
        for size in np.unique(np.minimum(length, LONG + 1)):
            if size > LONG:
                for i in np.flatnonzero(length > LONG):
                    out[i] = self.merge_long(self.byte_ids[data[begin[i] : begin[i] + length[i]]])
        edges = [*range(1, 17), 20, 24, 32, 48, LONG]
        bucket = np.searchsorted(edges, np.minimum(length, LONG))
        for k in np.unique(bucket[length <= LONG]):
            i = np.flatnonzero((bucket == k) & (length <= LONG))
            cols = np.arange(edges[k])
            inside = cols < length[i, None]
            m = np.where(inside, self.byte_ids[data[np.minimum(begin[i, None] + cols, len(data) - 1)]], np.int32(-1))
            for rows, ids in self.merge_rows(m):
                n = (ids >= 0).sum(1)
                flat, ends = ids[ids >= 0], np.cumsum(n)
                for x, e, c in zip(i[rows].tolist(), ends.tolist(), n.tolist()):
                    out[x] = flat[e - c : e]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return counts, np.concatenate(out) if out else np.zeros(0, np.int32)

    def recall(self, h: np.ndarray, check: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``self.ids`` the ids of each piece (sorted by hash) begin, and how many they are; learns new pieces."""
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        fresh = np.flatnonzero((self.known[at] != h) | (self.check[at] != check)) if len(self.known) else np.arange(len(h))
        start, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if len(self.known):
            start, count = self.begin[at], self.count[at]
        if len(fresh):
            n, ids = self.encode_pieces(data, begin[fresh], length[fresh])
            own = len(self.ids) + np.cumsum(n) - n
            start[fresh], count[fresh] = own, n
            self.ids = np.concatenate([self.ids, ids])
            known = np.concatenate([self.known, h[fresh]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.check = np.concatenate([self.check, check[fresh]])[order]
            self.begin, self.count = np.concatenate([self.begin, own])[order], np.concatenate([self.count, n])[order]
        return start, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids one after another."""
        cp, starts = points(texts)
        if not len(cp):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        if len(self.known) > REMEMBERED:
            self.forget()
        first = np.flatnonzero(piece_starts(cp, starts))
        size = np.diff(np.append(first, len(cp)))
        place = np.arange(len(cp)) - np.repeat(first, size)
        p = powers(int(size.max()))[place]
        c = cp.astype(U) + U(1)
        h = mix(np.add.reduceat(mix(c) * p, first) + size.astype(U))
        check = np.add.reduceat(mix(c ^ U(0xABCDEF)) * p, first)
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        begin, length = offset[first], offset[first + size] - offset[first]
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        if (check != check[one][inverse]).any():  # two pieces under one hash: tell them apart by both
            h = mix(h ^ check)
            _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        at, n = self.recall(h[one], check[one], data, begin[one], length[one])
        at, n = at[inverse], n[inverse]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(at - (ends - n), n) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(first, starts)]
        return np.diff(upto), ids


def piece_starts(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each code point, whether a piece of the splitting pattern begins there."""
    n, kind = len(cp), classes()[cp]
    new = np.zeros(n + 1, bool)
    new[starts] = True
    run = new[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    begin = run.copy()
    # the last white space before other characters stands apart; a plain space there leads the next piece
    follows = np.zeros(n, bool)
    follows[:-1] = space[:-1] & ~space[1:] & ~new[1:n]
    begin |= follows
    led = np.zeros(n, bool)
    led[1:] = follows[:-1] & (cp[:-1] == 0x20)
    begin &= ~led
    # contractions: an apostrophe alone between its neighbours, then one of the endings
    at = np.flatnonzero((cp == 0x27) & run & begin)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~new[at + 1]]
    if len(at):
        nxt = cp[at + 1]
        two = np.where(at + 2 < n, cp[np.minimum(at + 2, n - 1)], 0) * ~new[np.minimum(at + 2, n)]
        one = np.isin(nxt, [ord(x) for x in "stmd"])
        pair = ((nxt == ord("r")) & (two == ord("e"))) | ((nxt == ord("v")) & (two == ord("e"))) | ((nxt == ord("l")) & (two == ord("l")))
        for hit, width in ((one, 2), (pair & ~one, 3)):
            a = at[hit]
            begin[a + 1] = False
            e = a + width
            e = e[e < n]
            begin[e[(kind[e] == LETTER) & ~new[e]]] = True
    assert OTHER == 0
    return begin


@functools.lru_cache(2)
def vocabulary(data: bytes) -> Vocabulary:
    """One for each worker process and rank file."""
    return Vocabulary(data)


def read_ranks(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK_POINTS:
            yield at, texts[at:i]
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, texts[at:]


def encoded(df: DataFrame, key: str, text: str, ranks: bytes, counts_only: bool = False) -> DataFrame:
    """``key, ids array<int>`` for every row of ``df``, or ``key, n_tokens bigint``.

    Null and empty texts have an empty list (and 0 tokens). No special token is known: their strings are ordinary text.
    Texts are encoded whole, whatever their length. Rows keep their number and keys, also null and repeated ones; other
    columns are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(ranks)  # the vocabulary file, below 1 MB
    kind = df.select(key).dtypes[0][1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(data.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, part in _chunks(texts):
                n, ids = v.encode(part)
                own = batch.column(0).slice(at, len(part))
                if counts_only:
                    yield pa.RecordBatch.from_arrays([own, pa.array(n)], [key, "n_tokens"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    out = "n_tokens bigint" if counts_only else "ids array<int>"
    return df.select(key, text).mapInArrow(work, f"`{key}` {kind}, {out}")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(d, "doc_id", "text", read_ranks())


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
