"""Whole batches of texts as words and hashes, by numpy over the Arrow buffer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes looked at together; a longer text is taken alone.
CHUNK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)
_BYTE = (_LOW + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)  # A-Z as a-z
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", 0) < n:
        size = max(n, CHUNK) + 1
        for name, base in (("up", _BASE), ("down", _BACK)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row)
        _powers["n"] = size - 1
    return _powers["up"], _powers["down"]


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    rows: range  # of the batch
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of rows in data
    hashes: np.ndarray  # of words, A-Z taken as a-z
    first: np.ndarray  # first word of each row, and the number of words


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """The batch in pieces of about CHUNK bytes; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK, "right")) - 1)
        to = min(to, len(texts))
        yield _words(range(at, to), raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def _words(rows: range, data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        return Words(rows, data, offsets, np.zeros(0, np.uint64), np.zeros(len(rows) + 1, np.int64))
    inside = ~BLANK[data]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[cut] = False
    after[-1], after[:-1] = False, inside[1:]
    after[cut - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = scramble((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(rows, data, offsets, hashes, np.searchsorted(start, offsets))


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each row, its distinct k-word shingle hashes in ascending order.

    A row of fewer words has one shingle, all its words; one of none has none.
    """
    h = words.hashes
    mul = np.uint64(0xFF51AFD7ED558CCD)
    acc = h[: max(0, len(h) - k + 1)].copy()
    for j in range(1, k):
        acc = scramble(acc * mul + h[j : j + len(acc)])
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(acc[a : b - k + 1])
        elif b > a:
            one = h[a : a + 1].copy()
            for j in range(a + 1, b):
                one = scramble(one * mul + h[j : j + 1])
            yield scramble(one + np.uint64(b - a))
        else:
            yield h[:0]
