"""Whole batches of texts as arrays of code points: character classes, words, word runs and their hashes.

Everything here is numpy over one Arrow batch; no loop runs over characters or words.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: The code points of the Unicode property White_Space. Fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers that Unicode 16 added, by first and last code point: the tokenizers' libraries know them, an older
#: Python's tables don't. Fixed values.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

U = np.uint64


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    for kind, spans in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in spans:
            t[first : last + 1] = np.where(t[first : last + 1] == OTHER, kind, t[first : last + 1])
    t[WHITE_SPACE] = SPACE
    return t


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and where each text begins (with the end, one more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15 | 1, U), dtype=U)


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of an odd number, modulo 2**64."""
    return _powers(1 << max(6, int(n - 1).bit_length()))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words (longest runs of letters and digits, in lower case): the text's index, and a hash of 64 bits."""
    cp, starts = points([t.lower() for t in texts])
    kind = classes()[cp]
    inside = (kind == LETTER) | (kind == NUMBER)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, U)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(starts))[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (np.diff(doc_of) > 0)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    value = mix(cp[at].astype(U) + U(1)) * powers(int(length.max()))[place]
    return doc_of[first], mix(np.add.reduceat(value, first))


def runs(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of all runs of ``k`` consecutive words of each text: the text's index and a hash, sorted by both.

    Texts with fewer than ``k`` words have none.
    """
    doc, h = word_hashes(texts)
    if len(h) < k:
        return doc[:0], h[:0]
    n = len(h) - k + 1
    s = np.zeros(n, U)
    for i in range(k):
        s = mix(s * U(0xD6E8FEB86659FD93) + h[i : i + n])
    whole = doc[:n] == doc[k - 1 :]
    doc, s = doc[:n][whole], s[whole]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (np.diff(doc) > 0) | (s[1:] != s[:-1])
    return doc[keep], s[keep]
