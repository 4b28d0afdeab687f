"""Vectorised word hashing over Arrow string batches, for the operators that compare passages of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPLIT = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_LANE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Alphabet(NamedTuple):
    """``word``: which bytes belong to words; ``value``: the 64-bit value of each byte, A-Z as a-z."""

    word: np.ndarray
    value: np.ndarray


def alphabet(separators: str) -> Alphabet:
    """Words are the runs of bytes that the character class ``separators`` (of ASCII only) does not hold."""
    word = np.array([i > 127 or not re.match(f"[{separators}]", chr(i).lower()) for i in range(256)])
    return Alphabet(word, _BYTE[[ord(chr(i).lower()) if i < 128 else i for i in range(256)]])


SPACED = alphabet(r"\x20\x09-\x0D")
ALPHANUMERIC = alphabet(r"\x00-\x2F\x3A-\x60\x7B-\x7F")


class Words(NamedTuple):
    """``hash``, ``start`` and ``end`` (bytes from the row's start) by word; row i holds words [offset[i], offset[i + 1])."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and its inverse, modulo 2 ** 64, for i in 0..n."""
    if len(_powers.up) <= n:
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            a = np.full(max(n, _SPLIT) + 2, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers.up, _powers.down = out
    return _powers.up, _powers.down


_powers.up = _powers.down = np.empty(0, np.uint64)


def slices(texts: pa.Array, size: int = _SPLIT) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``size`` bytes of text each, so that the arrays below stay small; null becomes empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def words(texts: pa.Array, letters: Alphabet) -> Words:
    """The words of a slice. Equal words get equal hashes; unequal ones collide with odds of about 2 ** -60.

    Bytes are looked at in pieces of about _SPLIT that end between words, so that a long text takes little more than its words.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8, hi - lo, lo) if hi > lo else np.empty(0, np.uint8)
    offsets = offsets - lo
    found, at = [], 0
    while at < len(data):
        to = _between(data, letters, min(at + _SPLIT, len(data)))
        edges = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at
        value, start, end = _piece(data[at:to], edges, letters)
        found.append((value, start + at, end + at))
        at = to
    value, start, end = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    offset = np.searchsorted(start, offsets)
    base = np.repeat(offsets[:-1], np.diff(offset))
    return Words(value, start - base, end - base, offset)


def _between(data: np.ndarray, letters: Alphabet, at: int) -> int:
    """The first place from ``at`` on that is not within a word."""
    while at < len(data):
        outside = np.flatnonzero(~letters.word[data[at : at + 4096]])
        if len(outside):
            return at + int(outside[0])
        at += 4096
    return len(data)


def _piece(data: np.ndarray, edges: np.ndarray, letters: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a piece; ``edges`` are where rows begin within it."""
    inside = np.zeros(len(data) + 1, bool)
    np.take(letters.word, data, out=inside[:-1])
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    ends = inside[:-1] & ~inside[1:]
    both = edges[inside[edges] & inside[edges - 1]]  # a word ends with its row
    begins[both], ends[both - 1] = True, True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters.value[data] * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, across row bounds too; callers leave those out."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * _LANE[i]
    return mixed(out)
